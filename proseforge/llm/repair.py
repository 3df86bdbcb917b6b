"""Repair of conversation structure as lightest derivations, found by Knuth's agenda.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant
turn.  Rows are kept, given another role, deleted or preceded by inserted ones, at a cost.  What may be
derived are two kinds of items: an edit of the row at a place, and "from one state of the pattern, the
rows before a place are done and the pattern is in another state".  A rule joins an item of the second
kind with an edit of its place.  The weight of an item is its cost and, for equal costs, the letters of
its edits; a rule adds the costs and puts the letters one after another, so no item weighs less than
what it was derived from, and items leave the agenda by weight, each final when it does.

A conversation of any length is cut into blocks of bounded size.  Blocks are independent: each gives the
lightest derivation for every pair of states at its ends, and those of a conversation are then put together
in order.  Only letters, costs and digests take part in this; texts are looked up at the end.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import quoted
from proseforge.session import cut_lineage

#: Rows of a block.
BLOCK = 256
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The pattern: where a role, by its initial, leads from a state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
COMPLETE = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
Weight = tuple[int, str]
Item = tuple


def lightest(axioms: Iterable[tuple[Weight, Item]], edges, goals: set[Item]) -> dict[Item, Weight]:
    """Final weights of the items derived until all ``goals`` are final.

    ``edges(item)`` gives the hyperedges with ``item`` among their tails, as (head, tails in order).
    """
    agenda, chart, seen = list(axioms), {}, {}
    heapq.heapify(agenda)
    goals = set(goals)
    while agenda and goals:
        weight, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = weight
        goals.discard(item)
        for head, tails in edges(item):
            if head in chart or any(t not in chart for t in tails):
                continue
            cost, letters = 0, ""
            for t in tails:
                cost += chart[t][0]
                letters += chart[t][1]
            # Of several derivations of an item only lighter ones go on the agenda.
            if head not in seen or (cost, letters) < seen[head]:
                seen[head] = cost, letters
                heapq.heappush(agenda, (seen[head], head))
    return chart


def block_table(initials: str, faults: list[int], begins: Iterable[int] = STATES) -> list[Weight | None]:
    """The lightest edits of a block from each state in ``begins`` to each, in order of states; none where there are none."""
    n = len(initials)
    edits: list[list[tuple[Weight, Item]]] = []
    for i in range(n + 1):
        here = [((2, "I"), ("edit", i, "I", s)) for s in "ua"]
        if i < n:
            here.append(((3, "D"), ("edit", i, "D", "")))
            if faults[i] not in (BLANK, DUPLICATE):
                more = int(faults[i] == TRUNCATED)
                here.append(((more, "K"), ("edit", i, "K", initials[i])))
                here += [((2 + more, "R"), ("edit", i, "R", s)) for s in "ua"]
        edits.append(here)

    def joined(done: Item, edit: Item) -> tuple[Item, tuple[Item, Item]] | None:
        _, begin, i, state = done
        _, _, letter, symbol = edit
        after = state if letter == "D" else NEXT.get((state, symbol))
        return None if after is None else (("done", begin, i + (letter != "I"), after), (done, edit))

    def edges(item: Item) -> Iterator[tuple[Item, tuple[Item, Item]]]:
        if item[0] == "done":
            pairs = ((item, edit) for _, edit in edits[item[2]])
        else:
            pairs = ((("done", begin, item[1], state), item) for begin in begins for state in STATES)
        return (found for pair in pairs if (found := joined(*pair)))

    axioms = [((0, ""), ("done", s, 0, s)) for s in begins] + [x for here in edits for x in here]
    system = any(c == "s" and f not in (BLANK, DUPLICATE) for c, f in zip(initials, faults))
    ends = {START: [START, USER, ASSISTANT] + [SYSTEM] * system, SYSTEM: [SYSTEM, USER, ASSISTANT], USER: [USER, ASSISTANT], ASSISTANT: [USER, ASSISTANT]}
    chart = lightest(axioms, edges, {("done", a, n, b) for a in begins for b in ends[a]})
    return [chart.get(("done", a, n, b)) for a in STATES for b in STATES]


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: (conv, turn, role, text); nulls become one space.

    Of twenty values of the hash, 0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of
    it, 3 repeats the row and 4 makes its role ``user``.
    """
    space = F.lit(" ")
    plain = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), space)
    code = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    rows = df.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), code.alias("code"))
    rows = rows.filter("code <> 0")
    return rows.select(
        "conv", "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def conversation_key(conv: str) -> Column:
    """A conversation as text; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("c:"), F.col(quoted(conv)).cast("string")), F.lit("none"))


def marked_rows(rows: DataFrame, block: int) -> DataFrame:
    """(key, part, sub, seq, turn, role, digest, initial, fault): rows without texts, numbered within blocks.

    ``part`` is the stretch of turns a row is in, so no window holds more than what one stretch has.
    """
    words = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "key", "turn", "role", F.sha2("text", 256).alias("digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial"),
        F.when(words == "", BLANK).when(~F.right(words, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("ending"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).cast("long").alias("part"),
    )
    same = Window.partitionBy("key", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    narrow = narrow.withColumn("again", F.row_number().over(same))
    fault = F.when(F.col("ending") == BLANK, BLANK).when(F.col("again") > 1, DUPLICATE).otherwise(F.col("ending"))
    place = Window.partitionBy("key", "part").orderBy(F.asc_nulls_first("turn"), "role", "digest", "again")
    numbered = narrow.withColumn("fault", fault).withColumn("at", F.row_number().over(place) - 1)
    return numbered.select(
        "key", "part", F.floor(F.col("at") / block).cast("long").alias("sub"), (F.col("at") % block).cast("long").alias("seq"),
        "turn", "role", "digest", "initial", "fault",
    )


_TABLE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("part", T.LongType()), T.StructField("sub", T.LongType()),
    T.StructField("initials", T.StringType()), T.StructField("faults", T.ArrayType(T.LongType())), T.StructField("turns", T.ArrayType(T.LongType())),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("letters", T.ArrayType(T.StringType())),
])


def block_tables(marked: DataFrame) -> DataFrame:
    """One row per block: what its rows are, how its turns run, and its lightest edits between states.

    ``faults`` counts the faults by kind; ``turns`` holds the first, the last and the number of different ones.
    The first block of a conversation begins in one state only.  Blocks are small in bytes but costly, so they are spread
    over a stated number of tasks, which adaptive planning does not merge.
    """
    keys = ["key", "part", "sub"]
    spread = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = marked.repartition(spread, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "initial", "fault", "turn"))).alias("rows"))
    firsts = marked.groupBy("key").agg(F.min("part").alias("first"))
    first = (F.col("part") == F.col("first")) & (F.col("sub") == 0)
    gathered = gathered.join(firsts, "key").select(*keys, "rows", first.alias("first")).repartition(spread, *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {name: [] for name in _TABLE.names[3:]}
            for rows, is_first in zip(batch.column(3), batch.column(4).to_pylist()):
                rows = rows.as_py()
                initials, faults = "".join(r["initial"] for r in rows), [r["fault"] for r in rows]
                turns = [r["turn"] for r in rows if r["turn"] is not None]
                table = block_table(initials, faults, (START,) if is_first else STATES)
                made["initials"].append(initials)
                made["faults"].append([faults.count(k) for k in range(4)])
                made["turns"].append([turns[0], turns[-1], len(set(turns))] if turns else [])
                made["costs"].append([w and w[0] for w in table])
                made["letters"].append([w and w[1] for w in table])
            longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
            kinds = {"initials": pa.string(), "faults": longs, "turns": longs, "costs": longs, "letters": texts}
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(made[n], k) for n, k in kinds.items()]], names=_TABLE.names)

    return gathered.mapInArrow(run, _TABLE)


class Conversation:
    """The blocks of a conversation put together, one after another."""

    def __init__(self):
        self.weights: dict[int, Weight] = {START: (0, "")}
        #: By block and end state: the state before it and its letters.
        self.ways: list[dict[int, tuple[int, str]]] = []
        self.blocks: list[tuple[int, int, str]] = []
        self.counts, self.illegal, self.before = [0] * 4, 0, ""
        self.turns: list[int] = []

    def add(self, part: int, sub: int, initials: str, faults: list[int], turns: list[int], costs: list, letters: list) -> None:
        found: dict[int, tuple[Weight, int, str]] = {}
        for a, (cost, before) in self.weights.items():
            for b in STATES:
                if (more := costs[4 * a + b]) is not None:
                    piece = letters[4 * a + b]
                    if b not in found or (cost + more, before + piece) < found[b][0]:
                        found[b] = (cost + more, before + piece), a, piece
        self.weights = {b: w for b, (w, _, _) in found.items()}
        self.ways.append({b: (a, piece) for b, (_, a, piece) in found.items()})
        self.blocks.append((part, sub, initials))
        self.counts = [x + y for x, y in zip(self.counts, faults)]
        run = self.before + initials
        self.illegal += sum(run[i : i + 2] not in LEGAL for i in range(len(run) - 1))
        self.before = run[-1:]
        if turns:
            first, last, n = turns
            seen = self.turns
            self.turns = [seen[0], last, seen[2] + n - (first == seen[1])] if seen else turns

    def report(self) -> dict[str, object]:
        state = min((s for s in COMPLETE if s in self.weights), key=self.weights.__getitem__)
        cost, audit = self.weights[state]
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
                "illegal": self.illegal, "cost": cost, "audit": audit, "_state": state}

    def edits(self, state: int) -> Iterator[dict[str, object]]:
        """Edits in order: the row of the block (none for inserted ones) and the role that it gets."""
        pieces = []
        for way in reversed(self.ways):
            state, piece = way[state]
            pieces.append(piece)
        place, state = 0, START
        for (part, sub, initials), piece in zip(self.blocks, reversed(pieces)):
            seq = 0
            for letter in piece:
                symbol = initials[seq] if letter == "K" else next((s for s in "ua" if (state, s) in NEXT), "")
                yield {"part": part, "sub": sub, "seq": None if letter == "I" else seq, "edit": letter,
                       "new_role": ROLES[symbol] if letter in "IR" else None, "place": place}
                if letter != "D":
                    state = NEXT[state, symbol]
                seq += letter != "I"
                place += 1


_CHOICE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("part", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType()), T.StructField("place", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()),
])


def choices(tables: DataFrame) -> DataFrame:
    """The edits of all conversations, and a row with ``audit`` and counts for each.

    Blocks of a conversation come in order through one task, which keeps their letters only.
    """
    rows = tables.repartition("key").sortWithinPartitions("key", "part", "sub")
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in _CHOICE.fields]

    def rows_of(key: str, conversation: Conversation) -> Iterator[dict[str, object]]:
        report = conversation.report()
        state = report.pop("_state")
        yield {"key": key, **report}
        for edit in conversation.edits(state):
            yield {"key": key, **edit}

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        now = conversation = None
        for batch in batches:
            for row in batch.to_pylist():
                key = row.pop("key")
                if key != now:
                    if conversation:
                        yield from rows_of(now, conversation)
                    now, conversation = key, Conversation()
                conversation.add(**row)
        if conversation:
            yield from rows_of(now, conversation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, object]] = []
        pack = lambda: pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in held], k) for n, k in zip(_CHOICE.names, kinds)], names=_CHOICE.names)
        for row in all_rows(batches):
            held.append(row)
            if len(held) == 5_000:
                yield pack()
                held = []
        yield pack()

    return rows.mapInArrow(run, _CHOICE)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of conversations; both have ``key``, the conversation as text.

    Rows stand in order of turn (nulls first, ties by role, then by digest of the text); null roles and texts
    are one space.  The first fault of a row counts: ``blank`` without anything but white space, ``duplicate``
    if role and text were there before, ``truncated`` if the last sign is none of ``.!?``.  Keeping a row
    costs 0, another role 2, deleting 3, an inserted empty turn of a user or assistant 2, and a truncated row
    that is not deleted 1 more; blank and duplicate rows must be deleted.  Of the cheapest edits those with
    the least letters (D, I, K, R) are taken.

    The report has a row per conversation with rows: ``gaps`` in the turn numbers, the faults, adjacent roles
    that are not in order (``illegal``), ``cost`` and ``audit``, the letters of its edits.  A repaired row has
    its ``place`` in the conversation, ``edit``, ``role`` and ``text``.  Roles count by their first letter,
    and others than s, u and a fit nowhere.  An empty table gives empty ones; other columns are not returned.
    """
    plain = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")).alias
    rows = df.select(conversation_key(conv).alias("key"), F.col(quoted(turn)).cast("long").alias("turn"), plain(role)("role"), plain(text)("text"))
    marked = cut_lineage(marked_rows(rows, block), "marked")
    chosen = cut_lineage(choices(block_tables(marked)), "edits")
    report = chosen.filter("audit is not null").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = chosen.filter("edit is not null")
    kept = edits.filter("edit in ('K', 'R')").join(marked.select("key", "part", "sub", "seq", "role", "digest"), ["key", "part", "sub", "seq"])
    # A kept row is the first of its role and text, so these name its text.
    texts = rows.select("key", "role", F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["key", "role", "digest"])
    kept = kept.join(texts, ["key", "role", "digest"]).select("key", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.filter("edit = 'I'").select("key", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return report, kept.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """(key, sha256) of each conversation's ``role:text`` lines joined by newlines; one row is held at a time."""
    rows = repaired.select("key", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("key").sortWithinPartitions("key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, found = batch.column(0).to_pylist(), []
            for key, line in zip(keys, batch.column(2)):
                if key != now:
                    if state:
                        found.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(memoryview(line.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["key", "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, state.hexdigest())], names=["key", "sha256"])

    return rows.mapInArrow(run, "key string, sha256 string")
