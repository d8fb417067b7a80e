"""Conversation structure repair by a generalised LR parser.

A conversation is right when its roles, by their first letters, read ``(s?(ua)+)?``.
The grammar is  C -> e | Y,  Y -> X u a | Y u a,  X -> e | s.  Its LR automaton runs
on every stack that an edit can lead to: a row is kept (K), gets another role (R,
user or assistant), is deleted (D), or a row without text is inserted (I) anywhere.
Stacks share their beginnings as nodes of one graph; stacks with equal tops merge and
keep the least (cost, audit), where the audit lists the edits.  A proper prefix of an
audit over the same rows lacks insertions and so costs less; the merge is therefore
right for whatever follows.

Blank rows and duplicates must go; a kept or reroled row whose text is cut off costs
more.  A duplicate has role and text of an earlier row of its conversation.

On Spark rows are sorted by (conversation, turn, role, digest of the text) in ranges,
so a conversation of any length spreads over tasks.  Texts that recur at a later turn
of their conversation come from one aggregation.  A task finishes every conversation
that lies within its range.  The first and the last of a range, and what is longer than
``PIECE`` rows, become pieces: one letter a row goes to the conversation's task, which
runs the parser over all its pieces in order and returns each piece's audit; the pieces
apply theirs where they lie.  Only these letters, about five bytes a row, of one
conversation meet in one task.

Defined cases: a null id is a conversation of its own; null turns come first; null
roles and texts read as one space; of equal turns the lesser role, then the lesser
SHA-256 of the text comes first; repeated rows are duplicates; a conversation whose
rows are all gone has an empty repair; very long texts are whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import each_row, lean, parallelism, stored
from promptloom.operators.joins import MAX_BROADCAST_BYTES, n_bytes

BLANKS = " \t\n\x0b\x0c\r"
#: Rows, and bytes of text, of a piece.
PIECE = 1024
PIECE_BYTES = 4 << 20
INSERT, REROLE, DELETE, CUT = 3, 3, 4, 3
ROLES = {"u": "user", "a": "assistant"}


class Stacks:
    """The LR automaton of the role grammar, and its graph of stacks.

    States: 0 start, 1 s, 2 X, 3 X u, 4 X u a, 5 Y, 6 Y u, 7 Y u a."""

    SHIFT = {(0, "s"): 1, (2, "u"): 3, (3, "a"): 4, (5, "u"): 6, (6, "a"): 7}
    #: Reductions (symbol, length) before a letter, and those before anything.
    BEFORE = {(0, "u"): ("X", 0)}
    ALWAYS = {1: ("X", 1), 4: ("Y", 3), 7: ("Y", 3)}
    GOTO = {(0, "X"): 2, (0, "Y"): 5}
    ACCEPT = (0, 5)

    def __init__(self):
        self.nodes = [(0, None)]  # (state, node below)
        self.at = {(0, None): 0}
        self.rows: dict[str, dict] = {}

    def push(self, below: int, state: int) -> int:
        key = (state, below)
        if key not in self.at:
            self.at[key] = len(self.nodes)
            self.nodes.append(key)
        return self.at[key]

    def reduce(self, node: int, symbol: str, length: int) -> int:
        for _ in range(length):
            node = self.nodes[node][1]
        return self.push(node, self.GOTO[self.nodes[node][0], symbol])

    def read(self, node: int, letter: str) -> int | None:
        """The stack after a letter, or None."""
        while (self.nodes[node][0], letter) in self.BEFORE:
            node = self.reduce(node, *self.BEFORE[self.nodes[node][0], letter])
        state = self.SHIFT.get((self.nodes[node][0], letter))
        if state is None:
            return None
        node = self.push(node, state)
        while self.nodes[node][0] in self.ALWAYS:
            node = self.reduce(node, *self.ALWAYS[self.nodes[node][0]])
        return node

    def insertions(self, tops: dict) -> dict:
        """``tops`` (stack to least (cost, audit)) with any number of rows inserted."""
        done: dict = {}
        queue = [(value, node) for node, value in tops.items()]
        heapq.heapify(queue)
        while queue:
            (cost, audit), node = heapq.heappop(queue)
            if node in done:
                continue
            done[node] = (cost, audit)
            for letter in ROLES:
                after = self.read(node, letter)
                if after is not None and after not in done:
                    heapq.heappush(queue, ((cost + INSERT, audit + "I"), after))
        return done

    def row(self, node: int, kind: str) -> dict:
        """Where one row leads from a stack, insertions before it included.  Kinds: s u a
        x (another letter), in capitals where the text is cut off; ``-`` must go."""
        out: dict = {}

        def merge(after, value):
            if after is not None and (after not in out or value < out[after]):
                out[after] = value

        for top, (cost, audit) in self.insertions({node: (0, "")}).items():
            merge(top, (cost + DELETE, audit + "D"))
            if kind != "-":
                more = cost + CUT * kind.isupper()
                merge(self.read(top, kind.lower()), (more, audit + "K"))
                for letter in ROLES:
                    merge(self.read(top, letter), (more + REROLE, audit + "R"))
        return out

    def run(self, kinds: str, tops: dict) -> dict:
        """Least (cost, audit) of every stack after the rows ``kinds``."""
        for kind in kinds:
            known = self.rows.setdefault(kind, {})
            after: dict = {}
            for node, (cost, audit) in tops.items():
                if node not in known:
                    known[node] = list(self.row(node, kind).items())
                for top, (c, a) in known[node]:
                    value = (cost + c, audit + a)
                    if top not in after or value < after[top]:
                        after[top] = value
            tops = after
        return tops

    def end(self, tops: dict) -> tuple[int, str]:
        """The least value of an accepted stack, with insertions at the end."""
        return min(v for n, v in self.insertions(tops).items() if self.nodes[n][0] in self.ACCEPT)

    def apply(self, node: int, rows: list[dict], audit: str) -> tuple[int, list[dict]]:
        """The edits that ``audit`` says, from a stack on."""
        at, out = 0, []
        for action in audit:
            row = {"turn": None, "role": "", "text": ""} if action == "I" else rows[at]
            at += action != "I"
            if action in "IR":
                letter = next(x for x in ROLES if self.read(node, x) is not None)
                row = {**row, "role": ROLES[letter]}
            if action != "D":
                node = self.read(node, row["role"][:1])
            out.append({**row, "action": action})
        return node, out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after damage by c = crc32('<conv_id>:<turn>') % 20: 0
    loses a row (it stays as ``gone``, to name its conversation), 1 its text, 2 its
    ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls read as one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    c = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("shown", ".!?", "")).otherwise(F.col("shown"))
    rows = conversations.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("shown"), c.alias("c"),
                                F.explode(F.when(c == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("c") == 0).alias("gone"))


def _kinds(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, digest, fault (b, t or null) and ``again`` (the
    text came at an earlier turn)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn(
        "fault", F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t"))
    key = ["conv_id", "role", "digest"]
    seen = rows.filter(~F.col("gone")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count("turn").alias("n_turns"), F.min("turn").alias("least"), F.max("turn").alias("most"))
    some_null = F.col("n_turns") < F.col("n")
    recurring = seen.filter((F.col("least") < F.col("most")) | (some_null & (F.col("n_turns") > 0))).select(
        *[F.col(c).alias(f"s_{c}") for c in key], F.when(~some_null, F.col("least")).alias("since"), F.lit(True).alias("recurs"))
    recurring = stored(recurring, "conversation-recurring")
    if n_bytes(recurring) <= MAX_BROADCAST_BYTES:
        recurring = F.broadcast(recurring)
    same = F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("role") == F.col("s_role")) & (F.col("digest") == F.col("s_digest"))
    later = F.col("recurs") & F.when(F.col("since").isNull(), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("since"))
    return rows.join(recurring, same, "left").select(*rows.columns, F.coalesce(later, F.lit(False)).alias("again"))


_EDITS = "array<struct<action: string, turn: long, role: string, text: string>>"
_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Run:
    """A conversation's rows of one task, as they come, and their counts."""

    def __init__(self, conv_id, like: "_Run | None" = None):
        self.conv_id, self.rows, self.kinds, self.size = conv_id, [], [], 0
        self.count = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.turn = self.least = self.key = None
        self.turns = 0
        if like is not None:  # the next piece of one conversation
            self.turn, self.last, self.key = like.turn, like.last, like.key

    def add(self, turn, role, text, fault, digest, again):
        key = (turn, role, digest)
        fault = "b" if fault == "b" else "d" if again or key == self.key else fault
        self.key = key
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        self.count["blank"] += fault == "b"
        self.count["duplicate"] += fault == "d"
        self.count["truncated"] += fault == "t"
        self.count["illegal"] += self.last is not None and self.last + letter not in ("su", "ua", "au")
        self.first = self.first or letter
        self.last = letter
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn = turn
            self.least = turn if self.least is None else self.least
        self.kinds.append("-" if fault in ("b", "d") else letter.upper() if fault == "t" else letter)
        self.rows.append({"turn": turn, "role": role, "text": text})
        self.size += len(text)


def _gaps(least, most, turns) -> int:
    return 0 if least is None else most - least + 1 - turns


def repair(rows: DataFrame) -> DataFrame:
    """Repairs of conversations, rows (conv_id, turn, role, text and, where rows are lost,
    a boolean ``gone``): conv_id, block, blocks, edits (action, turn, role, text) and, in
    block 0, gaps, blank, duplicate, truncated, illegal and cost.  The repaired rows are the
    edits but for D, in the order of blocks."""
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest"]
    ordered = _kinds(rows).repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id())
    fields = (f"conv_id {kind}, part int, piece int, edits {_EDITS}, {_STATS}, kinds string, first string, last string, "
              "least long, most long, turns long")

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa
        stacks = Stacks()

        @lru_cache(maxsize=1 << 14)
        def cheapest(kinds: str):
            return stacks.end(stacks.run(kinds, {0: (0, "")}))

        def whole(run: _Run) -> dict:
            cost, audit = cheapest("".join(run.kinds))
            return {"conv_id": run.conv_id, "edits": stacks.apply(0, run.rows, audit)[1], "cost": cost,
                    "gaps": _gaps(run.least, run.turn, run.turns), **run.count}

        def piece(run: _Run, n: int) -> dict:
            return {"conv_id": run.conv_id, "part": part, "piece": n, "kinds": "".join(run.kinds), "first": run.first, "last": run.last,
                    "least": run.least, "most": run.turn, "turns": run.turns, "edits": [{"action": None, **r} for r in run.rows], **run.count}

        schema, part, run, is_open, n_pieces, out, size = None, None, None, True, 0, [], 0
        for b in batches:
            if schema is None:
                schema = _schema(fields, b.schema.field("conv_id").type)
            columns = [b.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "text", "fault", "digest", "again", "gone")]
            for part_now, conv, turn, role, text, fault, digest, again, gone in zip(*columns):
                if run is None:
                    part, run = part_now, _Run(conv)
                elif conv != run.conv_id:
                    if is_open:
                        out.append(piece(run, n_pieces))
                        n_pieces += 1
                    else:
                        out.append(whole(run))
                    size += run.size
                    run, is_open = _Run(conv), False
                elif len(run.rows) >= PIECE or run.size > PIECE_BYTES:
                    out.append(piece(run, n_pieces))
                    n_pieces += 1
                    size += run.size
                    run, is_open = _Run(conv, run), True
                if not gone:
                    run.add(turn, role, text, fault, digest, again)
                if len(out) >= 1000 or size > PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if run is not None:
            out.append(piece(run, n_pieces))
            yield pa.RecordBatch.from_pylist(out, schema)

    found = stored(ordered.mapInArrow(lean(parse), fields), "conversation-parts")
    stats = [s.split()[0] for s in _STATS.split(", ")]
    closed = found.filter(F.col("part").isNull()).select("conv_id", F.lit(0).alias("block"), F.lit(1).alias("blocks"), "edits", *stats)
    pieces = found.filter(F.col("part").isNotNull())
    chosen = _chosen(pieces.drop("edits"), kind)
    texts = pieces.select("part", "piece", F.col("edits").alias("rows"))
    return closed.unionByName(_applied(texts.join(chosen, ["part", "piece"]), kind))


def _schema(fields: str, conv_type):
    """The Arrow schema of a field list, with ``conv_id`` as Arrow has it."""
    import pyarrow as pa
    edit = pa.struct([("action", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [f.split(" ") for f in fields.replace(_EDITS, "edits").split(", ")]
    return pa.schema([(n, conv_type if n == "conv_id" else pa.list_(edit) if t == "edits" else kinds[t]) for n, t in names])


def _chosen(pieces: DataFrame, kind: str) -> DataFrame:
    """part, piece, conv_id, block, blocks, stack, audit and counts: what every piece does."""
    fields = f"part int, piece int, conv_id {kind}, block int, blocks int, stack string, audit string, {_STATS}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        stacks = Stacks()
        schema = None

        def solved(conv: list[dict]) -> list[dict]:
            tops, back = {0: (0, "")}, []
            for p in conv:  # per stack after the piece: its cost, the stack before, the piece's audit
                reached: dict = {}
                for node in tops:
                    for top, (c, a) in stacks.run(p["kinds"], {node: (0, "")}).items():
                        reached.setdefault(top, []).append((node, c, a))
                after, step = {}, {}
                for top, ways in reached.items():
                    (cost, audit), node, a = min(((tops[n][0] + c, tops[n][1] + a), n, a) for n, c, a in ways)
                    after[top], step[top] = (cost, audit), (node, a)
                tops = after
                back.append(step)
            (cost, audit), top = min((stacks.end({n: value}), n) for n, value in tops.items())
            tail = audit[len(tops[top][1]):]
            audits = []
            for step in reversed(back):
                node, a = step[top]
                audits.append((node, a))
                top = node
            audits = audits[::-1]
            audits[-1] = (audits[-1][0], audits[-1][1] + tail)
            count = {c: sum(p[c] for p in conv) for c in _COUNTS}
            # borders between pieces of one task are counted already
            full = [p for p in conv if p["first"]]
            count["illegal"] += sum(x["part"] != y["part"] and x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(full, full[1:]))
            dated = [p for p in conv if p["most"] is not None]
            turns = sum(p["turns"] for p in dated)
            turns -= sum(x["part"] != y["part"] and x["most"] == y["least"] for x, y in zip(dated, dated[1:]))
            least = [p["least"] for p in dated if p["least"] is not None]
            count["gaps"] = _gaps(least[0], dated[-1]["most"], turns) if least else 0
            out = [{"part": p["part"], "piece": p["piece"], "conv_id": p["conv_id"], "block": i, "blocks": len(conv),
                    "stack": _path(stacks, node), "audit": a} for i, (p, (node, a)) in enumerate(zip(conv, audits))]
            out[0].update(count, cost=cost)
            return out

        conv: list[dict] = []
        for b in batches:
            schema = schema or _schema(fields, b.schema.field("conv_id").type)
            for p in b.to_pylist():
                if conv and p["conv_id"] != conv[0]["conv_id"]:
                    yield pa.RecordBatch.from_pylist(solved(conv), schema)
                    conv = []
                conv.append(p)
        if conv:
            yield pa.RecordBatch.from_pylist(solved(conv), schema)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(lean(run), fields)


def _path(stacks: Stacks, node: int) -> str:
    """The states of a stack (node numbers differ between tasks)."""
    states = ""
    while node is not None:
        state, node = stacks.nodes[node]
        states = str(state) + states
    return states


def _applied(pieces: DataFrame, kind: str) -> DataFrame:
    fields = f"conv_id {kind}, block int, blocks int, edits {_EDITS}, {_STATS}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        stacks = Stacks()
        for b in batches:
            schema = _schema(fields, b.schema.field("conv_id").type)
            for p in each_row(b):
                node = 0
                for state in p["stack"][1:]:
                    node = stacks.push(node, int(state))
                p["edits"] = stacks.apply(node, p["rows"], p["audit"])[1]
                yield pa.RecordBatch.from_pylist([{n: p[n] for n in schema.names}], schema)

    return pieces.mapInArrow(lean(run), fields)


def digests(repairs: DataFrame) -> DataFrame:
    """conv_id, the counts, audit and repaired_sha256 of every conversation of :func:`repair`.
    A repair of several blocks is hashed block after block by one task."""
    kind = repairs.schema["conv_id"].dataType.simpleString()
    stats = [s.split()[0] for s in _STATS.split(", ")]
    # one text of a block: what stays, without its last newline
    texts = repairs.select(
        "conv_id", "block", "blocks", *stats, F.expr("array_join(transform(edits, e -> e.action), '')").alias("audit"),
        F.expr("array_join(transform(filter(edits, e -> e.action <> 'D'), e -> concat(e.role, ':', e.text)), '\n')").alias("text"),
        F.expr("exists(edits, e -> e.action <> 'D')").alias("some"))
    one = texts.filter(F.col("blocks") == 1).select("conv_id", *stats, "audit", F.sha2("text", 256).alias("repaired_sha256"))
    fields = f"conv_id {kind}, {_STATS}, audit string, repaired_sha256 string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        row = sha = schema = None
        for b in batches:
            schema = schema or _schema(fields, b.schema.field("conv_id").type)
            for p in each_row(b):
                if p["block"] == 0:
                    if row is not None:
                        yield pa.RecordBatch.from_pylist([{**row, "audit": "".join(row["audit"]), "repaired_sha256": sha.hexdigest()}], schema)
                    row, sha, started = {n: p[n] for n in ("conv_id", *stats)} | {"audit": []}, hashlib.sha256(), False
                row["audit"].append(p["audit"])
                if p["some"]:
                    sha.update(b"\n" * started + p["text"].encode())
                    started = True
        if row is not None:
            yield pa.RecordBatch.from_pylist([{**row, "audit": "".join(row["audit"]), "repaired_sha256": sha.hexdigest()}], schema)

    many = (texts.filter(F.col("blocks") > 1).repartition("conv_id").sortWithinPartitions("conv_id", "block")
            .mapInArrow(lean(run), fields))
    return one.unionByName(many)
