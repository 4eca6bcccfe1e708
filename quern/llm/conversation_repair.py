"""Repair of conversations by weighted finite-state composition: the rows of a conversation (an acceptor), an edit transducer
and a grammar of roles are composed as far as a path needs, and the shortest path by (cost, labels) is the repair.

Long conversations are cut into slices. A slice becomes a matrix of best paths from each grammar state to each, and matrices
multiply in the same weights, so that no task needs a whole conversation's rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import SPACE, Scratch, table

#: The grammar `(s?(ua)+)?` over the first letters of roles: state and letter to state.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
#: Pairs of neighbours that the grammar knows.
NEIGHBOURS = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Insertions in a row that a shortest path can hold: user and assistant from the start; more would come back to a state.
MOST_INSERTS = 2
#: Rows of a slice.
SLICE = 4096
FAULTS = ("", "blank", "duplicate", "truncated")
NAMES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]


def row_arcs(initial: str, fault: str, state: int) -> tuple[tuple[int, str, int], ...]:
    """Arcs (cost, label, next state) by which a row of a role's first letter and a fault is read in a grammar state."""
    out = [(DELETE, "D", state)]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        if (state, initial) in GRAMMAR:
            out.append((KEEP + extra, "K", GRAMMAR[state, initial]))
        out += [(REROLE + extra, "R", GRAMMAR[state, x]) for x in NAMES if (state, x) in GRAMMAR]
    return tuple(out)


INSERT_ARCS = {s: tuple((INSERT, "I", GRAMMAR[s, x]) for x in NAMES if (s, x) in GRAMMAR) for s in STATES}


def layer(arcs: dict[int, list], after: dict[str, dict]) -> dict[int, tuple]:
    """Best node by state: (cost, label, rank of what follows, next state, own rank). Labels are compared with what follows
    them: equal labels lead to one layer, whose ranks order its label strings. `after`: the layers by label."""
    best = {}
    for state, some in arcs.items():
        found = [(cost + after[label][to][0], label, after[label][to][4], to) for cost, label, to in some if to in after[label]]
        if found:
            best[state] = min(found)
    order = {x: i for i, x in enumerate(sorted({(b[1], b[2]) for b in best.values()}))}
    return {s: (*b, order[b[1], b[2]]) for s, b in best.items()}


def shortest(rows: tuple[tuple[str, str], ...], end: int | None) -> dict[int, Weight]:
    """The weights of the best paths over rows (first letter, fault) from each state to state `end`; None: to a final state,
    with insertions after the last row. The composed machine has a state for each row, insertion count and grammar state; it
    is topologically ordered, and is gone through from its end."""
    done = {s: (0, "", 0, s, 0) for s in (FINAL if end is None else (end,))}
    layers, known = [inserted({}, {"": done})] if end is None else [[done]], {}
    for initial, fault in reversed(rows):
        arcs = known.get((initial, fault)) or known.setdefault((initial, fault), {s: row_arcs(initial, fault, s) for s in STATES})
        layers.append(inserted(arcs, dict.fromkeys("DKR", layers[-1][0])))
    layers.reverse()
    out = {}
    for start, node in layers[0][0].items():
        labels, row, used, state = [], 0, 0, start
        while row < len(rows) or end is None:
            _, label, _, to, _ = layers[row][used][state]
            if not label:
                break
            labels.append(label)
            row, used, state = (row, used + 1, to) if label == "I" else (row + 1, 0, to)
        out[start] = (node[0], "".join(labels))
    return out


def inserted(arcs: dict[int, tuple], after: dict[str, dict]) -> list[dict]:
    """The layers of one row by insertions made before it: by its own arcs, or one insertion more; at the end, stop."""
    out: list[dict] = []
    for used in range(MOST_INSERTS, -1, -1):
        own = {s: [*(arcs.get(s) or ([(0, "", s)] if "" in after else [])), *(INSERT_ARCS[s] if used < MOST_INSERTS else ())] for s in STATES}
        out.insert(0, layer(own, after | ({"I": out[0]} if out else {})))
    return out


def matrix(rows: tuple[tuple[str, str], ...]) -> list[list[Weight | None]]:
    """Best weights from each state to each over the rows of a slice."""
    ends = [shortest(rows, e) for e in STATES]
    return [[ends[e].get(s) for e in STATES] for s in STATES]


def paths(matrices: list[list[list[Weight | None]]]) -> tuple[int, list[str]]:
    """Cost of the shortest path from the start over all slices to a final state, and its labels by slice; the last slice's
    with the insertions after it. Of one slice and start, no label string begins another of the same cost, so the best of
    two paths stays best whatever follows both."""
    closing = shortest((), None)
    ahead: dict[int, tuple[int, str, list[str]]] = {s: (c, labels, [labels]) for s, (c, labels) in closing.items()}
    for m in reversed(matrices):
        found = {s: [(w[0] + ahead[e][0], w[1] + ahead[e][1], [w[1], *ahead[e][2]]) for e in STATES if e in ahead and (w := m[s][e])] for s in STATES}
        ahead = {s: min(f) for s, f in found.items() if f}
    cost, _, parts = ahead[0]
    return cost, [*parts[:-2], "".join(parts[-2:])] if len(parts) > 1 else parts


def without_space(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, damaged by crc32(`conv_id:turn`) mod 20: 0 drops a row, 1 empties its
    text, 2 takes `.`, `!` and `?` out, 3 repeats it, 4 makes it the user's. Nulls of the key, of roles and of texts: one
    space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault of rows (conv_id, turn, role, text): blank, else duplicate (role and text stand in an
    earlier row), else truncated (the last character that isn't SPACE ends no sentence), else empty. The one window is over
    equal rows of a conversation."""
    bare = without_space(F.col("text"))
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    fault = F.when(bare == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return messages.select("conv_id", "turn", "role", "text", fault.alias("fault"))


@dataclass
class Repair:
    """summary: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, for each conversation with rows;
    rows: conv_id, place (from 0), edit (K, R or I), role, text, the repaired rows."""

    summary: DataFrame
    rows: DataFrame


SLICES = "conv_id long, at long, n long, first_turn long, last_turn long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, costs array<long>, labels array<string>"
DONE = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<edit:string,at:long,place:long,role:string>>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation's rows (conv_id, at, turn, initial, fault) in order, cut at SLICE rows, as matrices."""
    names, run, out, known = SLICES.replace(",", "").split()[::2], [], [], {}

    def weights(key: tuple[tuple[str, str], ...]) -> list:
        """Short slices are alike again and again."""
        if len(key) > 32:
            return matrix(key)
        if len(known) > 1 << 15:
            known.clear()
        return known.get(key) or known.setdefault(key, matrix(key))

    def close() -> None:
        conv, at, turns, initials, faults = run[0][0], run[0][1], [r[2] for r in run if r[2] is not None], [r[3] for r in run], [r[4] for r in run]
        flat = [w for line in weights(tuple(zip(initials, faults, strict=True))) for w in line]
        illegal = sum(a + b not in NEIGHBOURS for a, b in zip(initials, initials[1:], strict=False))
        counts = [faults.count(f) for f in FAULTS[1:]]
        out.append((conv, at, len(run), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), initials[0], initials[-1], illegal, *counts, [w and w[0] for w in flat], [w and w[1] for w in flat]))
        run.clear()

    def flush() -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [[]] * len(names)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.string())]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and (row[0] != run[0][0] or row[1] != run[-1][1] + 1 or len(run) == SLICE):
                close()
            run.append(row)
        yield flush()
    if run:
        close()
        yield flush()


def _joined(conv: int | None, slices: list[dict]) -> tuple:
    """A row of DONE from a conversation's slices."""
    slices = sorted(slices, key=lambda s: s["at"])
    matrices = []
    for s in slices:
        flat = [None if c is None else (c, w) for c, w in zip(s["costs"], s["labels"], strict=True)]
        matrices.append([flat[i : i + len(STATES)] for i in range(0, len(flat), len(STATES))])
    cost, parts = paths(matrices)
    n = sum(map(len, parts)) - sum(p.count("D") for p in parts)
    odd, place, edits = n % 2, 0, []
    for s, part in zip(slices, parts, strict=True):
        at = s["at"]
        for label in part:
            role = NAMES["ua"[(place - odd) % 2]] if label in "RI" else None
            if label != "D":
                edits.append({"edit": label, "at": None if label == "I" else at, "place": place, "role": role})
                place += 1
            at += label != "I"
    illegal = sum(s["illegal"] for s in slices) + sum(a["last"] + b["first"] not in NEIGHBOURS for a, b in zip(slices, slices[1:], strict=False))
    timed = [s for s in slices if s["turns"]]
    turns = sum(s["turns"] for s in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
    return (conv, sum(s["n"] for s in slices), gaps, *(sum(s[f] for s in slices) for f in FAULTS[1:]), illegal, cost, "".join(parts), edits)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DONE.split(", ")]
    edit = pa.struct([("edit", pa.string()), ("at", pa.int64()), ("place", pa.int64()), ("role", pa.string())])
    kinds = [pa.int64()] * 8 + [pa.string(), pa.list_(edit)]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [_joined(c, s) for c, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repair_conversations(messages: DataFrame, scratch: Scratch) -> Repair:
    """The cheapest repair of each conversation of messages (conv_id long, turn long, role, text; others ignored).

    Rows are taken by turn, nulls first, ties by role and text. Edits: keep a row (0), give it the role user or assistant
    (2), delete it (3; blank and duplicate rows must be), insert an empty row of either (2); a truncated row that stays costs
    1 more. Of the edits by which the roles' first letters match `(s?(ua)+)?` the cheapest are made, of equally cheap ones
    those whose letters (K, R, D, I) come first in ASCII. Nulls in role and text: empty, and so blank. Null conv_id: a
    conversation of its own. Unknown roles can't be kept. Repeated rows are duplicates. Empty table: empty results.

    Rows are sorted over ranges of (conv_id, turn, role), so a conversation of many rows lies in many tasks; each run of a
    conversation in a file is a slice, as a matrix of 16 weights. Slices meet by conversation, and the edits go back to the
    rows by their number. A conversation's label string is one value, and needs a letter for each of its rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = with_faults(rows).repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == "duplicate")
    kept = scratch.write(ranged.withColumn("at", F.monotonically_increasing_id()))
    slices = kept.select("conv_id", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "fault").mapInArrow(_slices, SLICES)
    by = slices.groupBy("conv_id").agg(F.collect_list(F.struct(*(c.split()[0] for c in SLICES.split(", ")[1:]))).alias("slices"))
    done = scratch.write(by.mapInArrow(_repaired, DONE))
    edits = done.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    stay = edits.filter("edit <> 'I'").withColumnRenamed("role", "given").join(kept.select("at", "role", "text"), "at")
    both = stay.select("conv_id", "place", "edit", F.coalesce("given", "role").alias("role"), "text")
    new = edits.filter("edit = 'I'").select("conv_id", "place", "edit", "role", F.lit("").alias("text"))
    return Repair(done.drop("edits"), both.unionByName(new))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    made = repair_conversations(damage(conversations), Scratch(spark))
    lines = made.rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line")))).alias("l"))
    digests = lines.select("conv_id", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("sha"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = every.unionByName(made.summary.select("conv_id", *numbers, "audit"), allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _sql() -> str:
    """Weights are lists [cost, labels] of one row's four states, relaxed row by row."""
    add = lambda w, cost, label: f"CASE WHEN {w} IS NOT NULL THEN {{'c': {w}.c + {cost}, 's': {w}.s || '{label}'}} END"
    least = lambda *ws: f"list_min(list_filter([{', '.join(ws)}], lambda w: w IS NOT NULL))"
    w = ["v0", "v1", least("v2", *(add(v, 2, "I") for v in ("v0", "v1", "v3"))), least("v3", add("v2", 2, "I"), add("v0", 4, "II"), add("v1", 4, "II"))]
    closed = ", ".join(f"{x} AS w{i}" for i, x in enumerate(w))
    may = lambda test, x: f"CASE WHEN NOT must AND {test} THEN {x} END"
    keep, again = (lambda v: add(v, "extra", "K")), (lambda v: add(v, "2 + extra", "R"))
    n = [
        add("w0", 3, "D"),
        least(add("w1", 3, "D"), may("i = 's'", keep("w0"))),
        least(add("w2", 3, "D"), *(may("i = 'u'", keep(v)) for v in ("w0", "w1", "w3")), *(may("true", again(v)) for v in ("w0", "w1", "w3"))),
        least(add("w3", 3, "D"), may("i = 'a'", keep("w2")), may("true", again("w2"))),
    ]
    step = ", ".join(f"{x} AS v{i}" for i, x in enumerate(n))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bits = "flatten(list_transform(range(1, length(k) + 1), lambda p: list_transform(range(8), lambda b: (CAST(ascii(k[p]) AS BIGINT) >> CAST(b AS BIGINT)) & 1)))"
    nothing = "CAST(NULL AS STRUCT(c BIGINT, s VARCHAR))"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda crc, b: xor(crc >> 1, 3988292384::BIGINT * (xor(crc, b) & 1))), 4294967295::BIGINT) % 20 AS how FROM keyed),
    hurt AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
             FROM (SELECT *, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE how <> 0)),
    placed AS (SELECT *, coalesce(conv_id, -9223372036854775808) AS g, rtrim(text, {space}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS nr
               FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM hurt)),
    faulty AS (SELECT *, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
    r AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra, i || lead(i) OVER (PARTITION BY g ORDER BY nr) AS pair FROM faulty),
    s AS (SELECT DISTINCT g, 0::BIGINT AS nr, {{'c': 0::BIGINT, 's': ''}} AS v0, {nothing} AS v1, {nothing} AS v2, {nothing} AS v3 FROM r
          UNION ALL SELECT g, nr, {step} FROM (SELECT r.g, r.nr, i, must, extra, {closed} FROM s JOIN r ON r.g = s.g AND r.nr = s.nr + 1)),
    ended AS (SELECT g, {least('w0', 'w3')} AS best FROM (SELECT g, {closed} FROM s QUALIFY nr = max(nr) OVER (PARTITION BY g))),
    sums AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
    labels AS (SELECT g, best.s AS audit, unnest(range(1, length(best.s) + 1)) AS p FROM ended),
    steps AS (SELECT g, p, audit[p] AS label, length(replace(left(audit, p), 'I', '')) AS nr, length(replace(left(audit, p), 'D', '')) - 1 AS place, length(replace(audit, 'D', '')) % 2 AS odd FROM labels),
    lines AS (SELECT steps.g, place, CASE label WHEN 'K' THEN role ELSE CASE WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE label WHEN 'I' THEN '' ELSE text END AS line
              FROM steps LEFT JOIN r ON r.g = steps.g AND r.nr = steps.nr WHERE label <> 'D'),
    digests AS (SELECT g, sha256(string_agg(line, chr(10) ORDER BY place)) AS sha FROM lines GROUP BY 1)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
           coalesce(best.s, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -9223372036854775808) AS g FROM conversations) o LEFT JOIN sums USING (g) LEFT JOIN ended USING (g) LEFT JOIN digests USING (g)"""


OP12_SQL = _sql()
