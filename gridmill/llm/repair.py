"""Conversation structure repair by weighted CYK parsing over spans of rows.

The target language is ``(s?(ua)+)?`` over role initials.  Its automaton has the states B (start), S, U and A; the grammar in Chomsky normal form has
one nonterminal per pair of states, the binary rules ``pq -> pr rq`` and, for every kind of row, unary rules for what an edit makes of it.  A cell
holds, for a span of rows and every nonterminal, the least (cost, audit), closed under insertions on both sides.  Cells of neighbouring
spans give the cell of their union, bottom-up by span length: inside a task by halves, then over the segments of a conversation that several
tasks hold.  A derivation of ``pq`` passes some state at every place between two rows, so all split points of a span give the same cell and one is enough.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill.llm.common import short_batches, staged

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
STEPS = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
PAIRS = ["BB", "BS", "BU", "BA", "SS", "SU", "SA", "UU", "UA", "AU", "AA"]
RULES = [(p + q, p + r, r + q) for p in "BSUA" for q in "BSUA" for r in "BSUA" if {p + q, p + r, r + q} <= set(PAIRS)]
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
SEGMENT_ROWS = 1 << 14  # rows of a conversation that one cell of the first level covers
CACHED_ROWS = 32        # spans up to this length are remembered by the worker


def best(cells: dict, pair: str, cost: int, audit: str) -> None:
    if pair not in cells or (cost, audit) < cells[pair]:
        cells[pair] = (cost, audit)


def combined(x: dict, y: dict) -> dict:
    """The cell of two neighbouring spans."""
    out: dict = {}
    for pair, left, right in RULES:
        if left in x and right in y:
            (a, s), (b, t) = x[left], y[right]
            best(out, pair, a + b, s + t)
    return out


def inserted() -> dict:
    """What insertions alone make: the empty span."""
    out = {p + p: (0, "") for p in "BSUA"}
    for _ in range(2):
        for (p, _), q in [x for x in STEPS.items() if x[0][1] != "s"]:
            for pair, (cost, audit) in list(out.items()):
                if pair[1] == p:
                    best(out, pair[0] + q, cost + INSERT, audit + "I")
    return out


EMPTY = inserted()


@lru_cache(maxsize=16)
def row_cell(kind: str) -> dict:
    """The cell of one row.  Kinds: ``d`` must go, else the role's initial (``o``: another one), in upper case if the text is cut off."""
    out = {p + p: (DELETE, "D") for p in "BSUA"}
    if kind != "d":
        cut = CUT if kind.isupper() else 0
        for (p, role), q in STEPS.items():
            if role == kind.lower():
                best(out, p + q, cut, "K")
            if role != "s":
                best(out, p + q, REROLE + cut, "R")
    return combined(combined(EMPTY, out), EMPTY)


@lru_cache(maxsize=1 << 15)
def short_cell(kinds: str) -> dict:
    return row_cell(kinds) if len(kinds) == 1 else combined(short_cell(kinds[:half(len(kinds))]), short_cell(kinds[half(len(kinds)):]))


def half(n: int) -> int:
    """The largest power of two below n."""
    return 1 << ((n - 1).bit_length() - 1)


def span_cell(kinds: str) -> dict:
    """The cell of a span of rows, one letter each, combined from cells of half its length."""
    if len(kinds) <= CACHED_ROWS:
        return short_cell(kinds) if kinds else EMPTY
    return combined(span_cell(kinds[:half(len(kinds))]), span_cell(kinds[half(len(kinds)):]))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults by the checksum of ``conv:turn``, modulo 20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its
    role user.  Nulls read as one space, in the checksum too; conv and turn stay as they are.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read(conv), F.lit(":"), read(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), kind.alias("kind"), read(role).alias("role"), read(text).alias("text"))
    return out.where("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_")).drop("_")


def in_order(rows: DataFrame) -> list[Column]:
    """Rows of a conversation go by turn, null first; rows of one turn by role, then by the digest of role and text."""
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("same").asc()]


def marked(rows: DataFrame) -> DataFrame:
    """The rows with nulls read as one space, and ``same``, a 128-bit digest of conversation, role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n"))
    out = rows.select("conv", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    return out.withColumn("same", F.md5(F.concat_ws(":", conv, F.char_length("role"), "role", "text").cast("binary")))


def kinds_of(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number: conv, turn, role, same, n, initial, fault (blank, duplicate, truncated or null)."""
    text = F.col("text")
    seen = rows.select(
        "conv", "turn", "role", "same", (~text.rlike(BLANK)).alias("blank"), (~text.rlike(ENDED)).alias("cut")).groupBy(
        "conv", "turn", "role", "same", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    seen = staged(seen, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = seen.where("NOT blank").groupBy("same").agg(F.min(place).alias("_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("_first") < place, "duplicate").when(F.col("cut"), "truncated")
    return seen.join(first, "same", "left").select("conv", "turn", "role", "same", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _segment_schema(conv: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    fields = [("conv", conv), ("segment", long), ("first", text), ("last", text), ("low", long), ("high", long), ("turns", long)]
    return T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(n, long) for n in COUNTS]
                        + [T.StructField("costs", T.ArrayType(long)), T.StructField("audits", T.ArrayType(text))])


def _joined(x: dict, y: dict) -> dict:
    """Two neighbouring segments of a conversation as one; turns go up from left to right."""
    out = {n: x[n] + y[n] for n in COUNTS}
    out["illegal"] += x["last"] + y["first"] not in ("su", "ua", "au")
    out |= {"conv": x["conv"], "segment": x["segment"], "first": x["first"], "last": y["last"],
            "low": y["low"] if x["low"] is None else x["low"], "high": x["high"] if y["high"] is None else y["high"],
            "turns": x["turns"] + y["turns"] - (x["high"] is not None and x["high"] == y["low"]), "cell": combined(x["cell"], y["cell"])}
    return out


def _segments(batches):
    """Cells of the runs of sorted rows that one task holds, at most ``SEGMENT_ROWS`` rows of a conversation each."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    now, kinds, out = None, [], []

    def closed():
        now["cell"] = span_cell("".join(kinds))
        return {k: v for k, v in now.items() if k != "cell"} | {
            "costs": [now["cell"].get(p, (None, None))[0] for p in PAIRS], "audits": [now["cell"].get(p, (None, None))[1] for p in PAIRS]}

    for batch in batches:
        for row in batch.to_pylist():
            left, turn, initial, fault = row["n"], row["turn"], row["initial"], row["fault"]
            while left:
                if now is None or now["conv"] != row["conv"] or len(kinds) >= SEGMENT_ROWS:
                    if now is not None:
                        out.append(closed())
                    now = {"conv": row["conv"], "segment": number, "first": initial, "last": None, "low": None, "high": None, "turns": 0} | dict.fromkeys(COUNTS, 0)
                    number, kinds = number + 1, []
                take = min(left, SEGMENT_ROWS - len(kinds))
                now["illegal"] += take - 1 + (now["last"] is not None and now["last"] + initial not in ("su", "ua", "au"))
                now["last"] = initial
                if turn is not None and turn != now["high"]:
                    now["turns"] += 1
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                kind = initial if initial in ("s", "u", "a") else "o"
                kind = "d" if fault in ("blank", "duplicate") else kind.upper() if fault == "truncated" else kind
                if fault == "blank":
                    now["blank"] += take
                    kinds += "d" * take
                else:
                    fresh = left == row["n"]  # all but the first of equal rows are duplicates
                    now["duplicate"] += take - fresh
                    if fresh and fault:
                        now[fault] += 1
                    kinds += [kind] * fresh + ["d"] * (take - fresh)
                left -= take
        if out:
            yield out
            out = []
    if now is not None:
        yield [closed()]


def _reports(batches):
    """One report per conversation from its segments, sorted; the pending ones have falling span lengths, so cells of like length are combined."""
    stack = []

    def closed():
        x = reduce(lambda y, z: _joined(z[1], y), reversed(stack[:-1]), stack[-1][1])
        ends = [x["cell"][p] for p in ("BB", "BA") if p in x["cell"]]
        cost, audit = min(ends)
        gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
        return {"conv": x["conv"], "gaps": gaps} | {n: x[n] for n in COUNTS} | {"cost": cost, "audit": audit}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            row["cell"] = {p: (c, a) for p, c, a in zip(PAIRS, row["costs"], row["audits"]) if c is not None}
            if stack and stack[-1][1]["conv"] != row["conv"]:
                out.append(closed())
                stack = []
            stack.append((1, row))
            while len(stack) > 1 and stack[-2][0] == stack[-1][0]:
                (n, x), (m, y) = stack[-2:]
                stack[-2:] = [(n + m, _joined(x, y))]
        if out:
            yield out
    if stack:
        yield [closed()]


def _edited(batches):
    """The repaired rows of conversations whose audit comes before their rows."""
    now, audit, state, at, nth, out = None, "", "B", 0, 0, []

    def put(role, text, edit):
        nonlocal state, nth
        state, nth = role[:1], nth + 1
        out.append({"conv": now, "nth": nth, "role": role, "text": text, "edit": edit})

    def insert():
        nonlocal at
        while audit[at:at + 1] == "I":
            put("assistant" if state == "u" else "user", "", "I")
            at += 1

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                insert()
                now, audit, state, at, nth = row["conv"], row["audit"], "B", 0, 0
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(row["role"] if edit == "K" else "assistant" if state == "u" else "user", row["text"], edit)
        if out:
            yield out
            out = []
    insert()
    if out:
        yield out


def _digests(batches):
    """The SHA-256 of the rows of each conversation as ``role:text`` lines."""
    now, digest = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            line = f"{row['role']}:{row['text']}".encode()
            if row["nth"] == 1:
                if digest is not None:
                    out.append({"conv": now, "repaired_sha256": digest.hexdigest()})
                now, digest = row["conv"], hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        if out:
            yield out
    if digest is not None:
        yield [{"conv": now, "repaired_sha256": digest.hexdigest()}]


def _mapped(rows: DataFrame, run, schema: T.StructType) -> DataFrame:
    """Run a function from Arrow batches to lists of rows over every partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist(x, schema=arrow) for x in run(batches)), schema)


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text): conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows go by turn, null first; rows of one turn by role, then by the digest of role and text, so equal rows stand together.  Nulls in role and text
    read as one space; a null conv is a conversation.  The first fault of a row counts: blank, duplicate (role and text stood earlier), truncated.  Keep costs
    0, rerole 2, delete 3 (required for blank and duplicate rows), insert 2; a truncated row that stays adds 1.  Of equally cheap repairs the
    audit that is least in ASCII order is taken.  No rows, no reports.

    Sorted ranges of (conv, turn) go to tasks, so a conversation of any length is shared by them; its cells are then combined in order.
    """
    spark = rows.sparkSession
    short_batches(spark)
    order = in_order(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = kinds_of(marked(rows)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = _segment_schema(rows.schema["conv"].dataType)
    segments = staged(_mapped(sorted_rows, _segments, schema), "segments")
    long = T.LongType()
    report = T.StructType([schema["conv"], *(T.StructField(n, long) for n in ["gaps", *COUNTS, "cost"]), T.StructField("audit", T.StringType())])
    return _mapped(segments.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "segment"), _reports, report)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: conv, nth (from 1), role, text, edit (K, R or I), by the audits of ``reports(rows)``.

    One conversation is written by one task, as a stream of its sorted rows: it holds a batch of rows and the audit, never the conversation.
    """
    short_batches(rows.sparkSession)
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"),
                         none("string").alias("same"), "audit")
    tails = marked(rows).select("conv", F.lit(1).alias("part"), "turn", "role", "text", "same", none("string").alias("audit"))
    order = in_order(rows)
    both = heads.union(tails).repartition("conv").sortWithinPartitions(order[0], "part", *order[1:])
    text = T.StringType()
    schema = T.StructType([rows.schema["conv"], T.StructField("nth", T.LongType()), T.StructField("role", text), T.StructField("text", text), T.StructField("edit", text)])
    return _mapped(both, _edited, schema)


def digests(fixed: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of the rows that ``repaired`` returns, as it orders them; conversations without a row are not there."""
    return _mapped(fixed, _digests, T.StructType([fixed.schema["conv"], T.StructField("repaired_sha256", T.StringType())]))


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct ``conv`` of ``ids``: its report and the digest of its repaired rows.

    Conversations without rows have zeros, an empty audit and the digest of an empty string.
    """
    found = staged(reports(rows), "reports")
    hashed = digests(repaired(rows, found))
    every = ids.select("conv").distinct()
    both = found.join(hashed, found["conv"].eqNullSafe(hashed["conv"]), "left").select(found["*"], "repaired_sha256")
    out = every.join(both, every["conv"].eqNullSafe(both["conv"]), "left")
    return out.select(every["conv"].alias("id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ["gaps", *COUNTS, "cost"]),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
