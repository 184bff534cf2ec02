"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A repaired conversation's role initials form ``(s?(ua)+)?``. Four grammar states say what has been
said: S nothing, A a system turn, B a user turn, C an assistant turn; S and C may end. The item
``rest(i, q)`` derives the rows from i on, standing in state q. Its deductions are hyperedges with two
tails, an edit of row i (or an insertion) and the item it leads to:

* ``keep(i)`` or ``rerole(i, x)`` with symbol x, and ``rest(i + 1, d(q, x))``, give ``rest(i, q)``
* ``delete(i)`` and ``rest(i + 1, q)`` give ``rest(i, q)``
* ``insert(x)`` and ``rest(i, d(q, x))`` give ``rest(i, q)``

A weight is (cost, audit): costs add, and the edit's letter (K, R, D, I) stands before the audit of the
rest. Putting a letter in front keeps the order of audits, so every deduction is monotone. A kept row
costs nothing, hence the agenda pops by (cost, rows covered, audit): each deduction raises the first two,
which makes it superior, and an item that pops first has its least weight. Items of one cost and
length don't feed each other; equal costs of one item are settled by their audits. The agenda
ends when the goal ``rest(0, S)`` pops. A long conversation is worked off from its end in stretches: the
four items at a stretch's left edge are finalised and are the axioms of the next one, so memory
is a few bytes a row.

Spark does the rest: faults are found by expressions, a repetition by a grouping of (conversation, role,
text) that is combined map-side and joined back, and rows reach the task that repairs their
conversation in order, as one code each and without their text. A second ordered pass applies the
audits to the rows with their text, streaming. One conversation's rows do pass through one task in
order, as its hash must; the texts are never held together.

Defined results: a missing role or text is one space; a missing conversation id is a conversation
of its own; missing turns come first. Rows of one turn are ordered by the MD5 of role and text.
A row's initial is its role's first character; an empty role has none and is never kept. A conversation
without rows has no gaps, faults or edits. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, durable, query, table
from perilake.session import reducers

ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
INITIALS = "sua"  # a row's code is 4 * fault + place of its initial here (3: another)
SOUND, CUT, VOID = 0, 1, 2  # faults as the repair sees them: void rows have to go
GONE = 12  # code of a row the damage dropped; it only names its conversation
LEADS_TO = {"A": (("S", "s"),), "B": (("S", "u"), ("A", "u"), ("C", "u")), "C": (("B", "a"),), "S": ()}
STRETCH = 512
SPACE = "\\x20\\x09-\\x0D"


class Rest:
    """A finalised item at a stretch's edge: cost, audit as its own part and the item that continues it."""

    __slots__ = ("cost", "own", "tail", "rank")

    def __init__(self, cost: int, own: str, tail: Rest | None):
        self.cost, self.own, self.tail, self.rank = cost, own, tail, 0


def edits(code: int) -> list[tuple[str, str, int]]:
    """(symbol, letter, cost) of the ways to leave a row in; only the lightest for each symbol."""
    fault, at = divmod(code, 4)
    if fault == VOID:
        return []
    extra = TRUNCATED if fault == CUT else 0
    found = {x: ("R", REROLE + extra) for x in ROLES}
    if at < len(INITIALS):
        found[INITIALS[at]] = ("K", KEEP + extra)
    return [(x, letter, cost) for x, (letter, cost) in found.items()]


EDITS = [edits(code) for code in range(GONE)]


def less(own: str, tail: Rest | None, other: str, other_tail: Rest | None) -> bool:
    """Whether the audit ``own`` + tail comes before ``other`` + its tail."""
    if own == other and tail is not None and other_tail is not None:
        return tail.rank < other_tail.rank
    while True:
        m = min(len(own), len(other))
        if own[:m] != other[:m]:
            return own < other
        own, other = own[m:], other[m:]
        while not own and tail is not None:
            own, tail = tail.own, tail.tail
        while not other and other_tail is not None:
            other, other_tail = other_tail.own, other_tail.tail
        if not own or not other:
            return not own and bool(other)


def stretch(codes: bytes, after: dict[str, Rest], goal: str | None) -> dict[str, Rest]:
    """Finalised items at the left edge of ``codes``, from those at its right edge; the goal alone if given."""
    best: dict[tuple[int, str], tuple[int, str, Rest]] = {}
    agenda: list[tuple[int, int, str]] = []
    done: set[tuple[int, str]] = set()
    left: dict[str, Rest] = {}

    def offer(i: int, q: str, cost: int, own: str, tail: Rest) -> None:
        held = best.get((i, q))
        if (i, q) in done or (held and (held[0] < cost or (held[0] == cost and not less(own, tail, held[1], held[2])))):
            return
        best[i, q] = cost, own, tail
        if not held or held[0] > cost:
            heapq.heappush(agenda, (cost, len(codes) - i, q))

    for q, rest in after.items():
        offer(len(codes), q, rest.cost, "", rest)
    while agenda:
        cost, covered, q = heapq.heappop(agenda)
        i = len(codes) - covered
        if (i, q) in done or best[i, q][0] != cost:
            continue
        done.add((i, q))
        _, own, tail = best[i, q]
        if i == 0:
            left[q] = Rest(cost, own, tail)
            if q == goal or len(left) == 4:
                break
        for before, symbol in LEADS_TO[q]:
            if symbol in ROLES:
                offer(i, before, cost + INSERT, "I" + own, tail)
        if i:
            offer(i - 1, q, cost + DELETE, "D" + own, tail)
            for symbol, letter, price in EDITS[codes[i - 1]]:
                for before, needs in LEADS_TO[q]:
                    if needs == symbol:
                        offer(i - 1, before, cost + price, letter + own, tail)
    ordered: list[Rest] = []
    for rest in left.values():
        place = len(ordered)
        while place and less(rest.own, rest.tail, ordered[place - 1].own, ordered[place - 1].tail):
            place -= 1
        ordered.insert(place, rest)
    for rank, rest in enumerate(ordered):
        same = rank and not less(ordered[rank - 1].own, ordered[rank - 1].tail, rest.own, rest.tail)
        rest.rank = ordered[rank - 1].rank if same else rank
    return left


def lightest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation, ties to the least audit."""
    after = {q: Rest(0, "", None) for q in "SC"}
    for end in range(len(codes), 0, -STRETCH):
        start = max(0, end - STRETCH)
        after = stretch(codes[start:end], after, "S" if start == 0 else None)
    rest = after["S"]
    cost, parts = rest.cost, []
    while rest is not None:
        parts.append(rest.own)
        rest = rest.tail
    return cost, "".join(parts)


def md5_of_row() -> Column:
    return F.unhex(F.md5(F.concat(F.md5("role"), F.md5("text"))))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the stated damage; ``copies`` 0 marks a dropped row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn))) % 20
    given = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), hit.alias("hit"))
    return given.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"),
    )


def plans(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation.

    ``rows`` has ``conv_id, turn, role, text, copies``: a row stands ``copies`` times in its place, with 0
    it is not there and only names its conversation.
    """
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*[F.when(first == x, F.lit(i)) for i, x in enumerate(INITIALS)], F.lit(3))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), VOID).when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), CUT).otherwise(SOUND)
    there = F.col("copies") > 0
    coded = rows.select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, md5_of_row()).alias("mark"),
                        F.when(there, 4 * fault + initial).otherwise(GONE).alias("code"), F.greatest("copies", F.lit(1)).alias("copies"))
    # Equal rows of one turn stand together: their number is enough.
    counted = coded.groupBy("conv_id", "turn", "mark", "code").agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = counted.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min(place).alias("first"))
    seen = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("mark").eqNullSafe(F.col("m")))
    listed = seen.select("conv_id", "turn", "mark", "code", "n", (~place.eqNullSafe(F.col("first"))).alias("again"))
    ordered = listed.repartition(reducers(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, str]] = {}  # repairs depend on the codes alone, and short conversations repeat them
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        out: dict[str, list] = {n: [] for n in ("conv_id", *names)}
        here, started = None, False
        codes, low, high, turns, last, counts, illegal = bytearray(), None, None, 0, None, [0, 0, 0], 0

        def close() -> None:
            nonlocal codes, low, high, turns, last, counts, illegal
            found = known.get(key := bytes(codes))
            if found is None:
                found = lightest(key)
                if len(key) <= 64 and len(known) < 100_000:
                    known[key] = found
            gaps = high - low + 1 - turns if turns else 0
            for name, value in zip(("conv_id", *names), (here, gaps, *counts, illegal, *found), strict=True):
                out[name].append(value)
            codes, low, high, turns, last, counts, illegal = bytearray(), None, None, 0, None, [0, 0, 0], 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(v, id_type if n == "conv_id" else pa.string() if n == "audit" else pa.int64()) for n, v in out.items()], names=list(out))
            for v in out.values():
                v.clear()
            return batch

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, code, n, again in zip(*(column_values(batch, c) for c in ("conv_id", "turn", "code", "n", "again")), strict=True):
                if not started or conv != here:
                    if started:
                        close()
                    here, started = conv, True
                if code == GONE:
                    continue
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                fault, at = divmod(code, 4)
                for copy in range(n):
                    repeated = again or copy > 0
                    if fault == VOID:
                        counts[0] += 1
                    elif repeated:
                        counts[1] += 1
                    elif fault == CUT:
                        counts[2] += 1
                    if last is not None and (last, at) not in ((0, 1), (1, 2), (2, 1)):
                        illegal += 1
                    last = at
                    codes.append(4 * VOID + at if repeated else code)
            if len(out["conv_id"]) >= 4096 or sum(map(len, out["audit"])) > 1 << 22:
                yield flush()
        if started:
            close()
            yield flush()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit`` of the conversations after their edits, in order within partitions."""
    standing = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    given = standing.select("conv_id", F.lit(1).alias("kind"), "turn", md5_of_row().alias("mark"), "role", "text")
    first = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                           F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    ordered = given.unionByName(first).repartition(reducers(rows.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, audit, at, place, state = None, "", 0, 0, "S"
        out: dict[str, list] = {n: [] for n in ("conv_id", "position", "role", "text", "edit")}
        size = 0

        def put(role: str, text: str, edit: str) -> None:
            nonlocal place, size
            for name, value in zip(out, (here, place, role, text, edit), strict=True):
                out[name].append(value)
            place, size = place + 1, size + len(text)

        def due() -> str:
            """The symbol an inserted or reroled row has."""
            return "a" if state == "B" else "u"

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                symbol = due()
                put(ROLES[symbol], "", "I")
                at, state = at + 1, "BC"[symbol == "a"]

        def flush() -> pa.RecordBatch:
            nonlocal size
            types = {"conv_id": id_type, "position": pa.int64()}
            batch = pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.string())) for n, v in out.items()], names=list(out))
            for v in out.values():
                v.clear()
            size = 0
            return batch

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, kind, role, text in zip(*(column_values(batch, c) for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    inserts()
                    here, audit, at, place, state = conv, text, 0, 0, "S"
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(role, text, edit)
                    state = {"s": "A", "u": "B", "a": "C"}[role[0]]
                elif edit == "R":
                    symbol = due()
                    put(ROLES[symbol], text, edit)
                    state = "BC"[symbol == "a"]
                if size > 1 << 22:
                    yield flush()
        inserts()
        if out["conv_id"]:
            yield flush()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, position long, role string, text string, edit string")


def digests(fixed: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of rows that :func:`repaired` gives, hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(column_values(batch, c) for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != here:
                    if state is not None:
                        done.append((here, state.hexdigest()))
                    here, state = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            id_type = batch.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], id_type), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], id_type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    kind = fixed.schema["conv_id"].dataType.simpleString()
    return fixed.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired rows of conversations as they are (no damage)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", blank("role"), blank("text"), F.lit(1).alias("copies"))
    planned = durable(plans(rows))
    return planned, repaired(rows, planned)


SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS letters
  FROM conversations
), hit AS (  -- CRC-32: a byte is added, then eight times one bit is shifted out
  SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(letters, lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
     lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS hit
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, generate_series(1, CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM damaged
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), priced AS (  -- extra cost of leaving the row in; none if it has to go
  SELECT *, CASE WHEN blank OR again THEN NULL WHEN cut THEN 5 ELSE 0 END AS stay FROM faults
), walk AS (  -- weights are nine digits of cost, then the audit; an inserted row never pays, since removing its neighbour costs 2
  SELECT conv_id, max(n) AS k, '000000000' AS s, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, '000000000' AS c FROM priced GROUP BY conv_id
  UNION ALL
  SELECT w.conv_id, w.k - 1,
    least(printf('%09dD%s', CAST(left(s, 9) AS INT) + 2, substr(s, 10)),
          CASE WHEN initial = 's' THEN printf('%09dK%s', CAST(left(a, 9) AS INT) + stay, substr(a, 10)) END,
          printf('%09d%s%s', CAST(left(b, 9) AS INT) + stay + CAST(initial <> 'u' AS INT), CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, substr(b, 10))),
    least(printf('%09dD%s', CAST(left(a, 9) AS INT) + 2, substr(a, 10)),
          printf('%09d%s%s', CAST(left(b, 9) AS INT) + stay + CAST(initial <> 'u' AS INT), CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, substr(b, 10))),
    least(printf('%09dD%s', CAST(left(b, 9) AS INT) + 2, substr(b, 10)),
          printf('%09d%s%s', CAST(left(c, 9) AS INT) + stay + CAST(initial <> 'a' AS INT), CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END, substr(c, 10))),
    least(printf('%09dD%s', CAST(left(c, 9) AS INT) + 2, substr(c, 10)),
          printf('%09d%s%s', CAST(left(b, 9) AS INT) + stay + CAST(initial <> 'u' AS INT), CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, substr(b, 10)))
  FROM walk w JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.place = w.k
), found AS (
  SELECT conv_id, CAST(left(s, 9) AS BIGINT) AS cost, substr(s, 10) AS audit FROM walk WHERE k = 0
), left_in AS (
  SELECT p.*, substr(audit, place, 1) AS edit, row_number() OVER o AS nth, first_value(initial = 's' AND substr(audit, place, 1) = 'K') OVER o AS headed
  FROM priced p JOIN found f ON p.conv_id IS NOT DISTINCT FROM f.conv_id WHERE substr(audit, place, 1) <> 'D'
  WINDOW o AS (PARTITION BY p.conv_id ORDER BY place)
), told AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (nth - CAST(headed AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place)) AS sha
  FROM left_in GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN found f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN told t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""


@query("op13_conversation_repair", SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    planned = durable(plans(rows))
    told = digests(repaired(rows, planned)).withColumnRenamed("conv_id", "c")
    empty = hashlib.sha256(b"").hexdigest()
    return planned.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").fillna(empty, ["repaired_sha256"])
