"""Conversation structure repair: cheapest edits that leave one system turn at most, then user and assistant by turns.

Edits are a depth-first branch and bound. A node is a prefix of edits: rows done, role written last, cost. Suffix lower bounds, the
cost that the rows left need from each role, cut branches above the incumbent (cost, audit); children are tried by
their initial, so of equally cheap audits the least one is met first; and a table per node (rows done, role) drops
prefixes that come later at no lower cost. The stack runs empty, so the incumbent is proved. Since an audit names its cost, no
audit of a run of rows begins with another of equal cost, and the order of (cost, audit) survives whatever follows.

Rows are range-partitioned by (conversation, turn), so one conversation may lie over many tasks. A task solves those that begin and
end inside it. Pieces of others, of SEGMENT_ROWS rows at most, are solved apart: costs between roles per piece (a small
matrix), bounds from the pieces after it, edits for each role it may begin with, and the roles that follow one another.
What meets per conversation is then a few numbers a piece; only the hash of the repaired text runs along in order, as SHA-256 must.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.merkle_manifest import CRC_TABLE, crc32_sql

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 1 << 20
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
SEGMENT = "conv string, part int, seg int, roles array<string>, texts array<string>, turns array<bigint>, marks array<string>"
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

#: Costs of the edits, and what an undeleted truncated row adds.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Roles written last: none, system, user, assistant. What an insert or rerole writes next, and what a kept initial leads to.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIAL = {USER: "u", ASSISTANT: "a"}
#: Cost of ending after each role.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


# ------------------------------------------------------------------------------------------ search
# A row's sign: x for one that must be deleted, else its role's initial (o for none of the three), a capital if truncated.


@lru_cache(maxsize=None)
def edits(sign: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """(initial, role after, cost) of the edits of a row, by role before, without inserts, in order of initials."""
    out = []
    for role in range(4):
        moves = [("D", role, DELETE)]
        if sign != "x":
            more, own = (TRUNCATED if sign.isupper() else 0), sign.lower()
            if role in KEPT.get(own, {}):
                moves.append(("K", KEPT[own][role], KEEP + more))
            if INITIAL[NEXT[role]] != own:
                moves.append(("R", NEXT[role], REROLE + more))
        out.append(tuple(moves))
    return tuple(out)


def bounds(signs: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For every number of rows done, the least cost of the rest by role; ``after``: what follows the last row."""
    out = [after]
    for sign in reversed(signs):
        below = out[-1]
        plain = [min(cost + below[to] for _, to, cost in moves) for moves in edits(sign)]
        once = [min(plain[r], INSERT + plain[NEXT[r]]) for r in range(4)]
        out.append(tuple(min(once[r], INSERT + once[NEXT[r]]) for r in range(4)))
    return out[::-1]


def search(signs: str, start: int = NONE, after: tuple[int, ...] | None = None) -> tuple[int, str, int]:
    """(cost, audit, last role) of the least (cost, audit) over ``signs`` from role ``start``.

    Without ``after`` the rows end the conversation: inserts may follow and the last role must be none or assistant. With it the cost
    holds what follows, by the role that the rows end with, and no insert stands last.
    """
    n, closes = len(signs), after is None
    low = bounds(signs, END if closes else after)
    best_cost, best = low[0][start], None
    seen: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, "", 0, start, 0)]
    while stack:
        depth, initial, row, role, cost = stack.pop()
        if cost + low[row][role] > best_cost or (best is not None and cost + low[row][role] == best_cost):
            continue
        if seen.get((row, role), FAR) <= cost:
            continue
        seen[row, role] = cost
        if depth:
            del path[depth - 1 :]
            path.append(initial)
        if row == n and (not closes or role in (NONE, ASSISTANT)):
            best_cost, best = cost + low[row][role], ("".join(path), role)
            continue
        moves = [(m, row + 1, to, cost + c) for m, to, c in edits(signs[row])[role]] if row < n else []
        if row < n or closes:
            moves.append(("I", row, NEXT[role], cost + INSERT))
        for m, r, to, c in sorted(moves, reverse=True):
            if c + low[r][to] <= best_cost:
                stack.append((depth + 1, m, r, to, c))
    return best_cost, *best


@lru_cache(maxsize=1 << 16)
def search_short(signs: str) -> tuple[int, str, int]:
    """``search`` of a whole conversation, remembered."""
    return search(signs)


@lru_cache(maxsize=None)
def matrix_of(sign: str) -> np.ndarray:
    """Least cost from role to role over one row, inserts before it included."""
    out = np.full((4, 4), FAR, dtype=np.int64)
    for role in range(4):
        at, paid = role, 0
        for _ in range(3):
            for _, to, cost in edits(sign)[at]:
                out[role, to] = min(out[role, to], paid + cost)
            at, paid = NEXT[at], paid + INSERT
    return out


def matrix(signs: str) -> np.ndarray:
    """Least cost from role to role over a run of rows; neighbours are joined until one matrix is left."""
    all_ = np.stack([np.where(np.eye(4, dtype=bool), 0, FAR), *map(matrix_of, signs)])
    while len(all_) > 1:
        odd = all_[-1:] if len(all_) % 2 else all_[:0]
        a, b = all_[0 : 2 * (len(all_) // 2) : 2], all_[1::2]
        all_ = np.concatenate((np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR), odd))
    return all_[0]


def repaired(audit: str, roles: list[str], texts: list[str], start: int = NONE) -> list[str]:
    """The lines ``role:text`` that the edits leave."""
    out, row, role = [], 0, start
    for initial in audit:
        if initial == "I":
            role = NEXT[role]
            out.append(ROLE[role] + ":")
            continue
        if initial == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            role = KEPT[roles[row][:1]][role]
        elif initial == "R":
            role = NEXT[role]
            out.append(f"{ROLE[role]}:{texts[row]}")
        row += 1
    return out


# ------------------------------------------------------------------------------------------- faults


def signs_of(roles: list[str], texts: list[str], repeats: list[bool]) -> tuple[str, list[int]]:
    """Signs of the rows, and how many are blank, duplicate and truncated; a row's first fault counts."""
    signs, counts = [], [0, 0, 0]
    for role, text, repeat in zip(roles, texts, repeats):
        end = text.rstrip(WHITE)[-1:]
        sign = role[:1] if role[:1] in KEPT else "o"
        if not end or repeat:
            counts[0 if not end else 1] += 1
            sign = "x"
        elif end not in ".!?":
            counts[2] += 1
            sign = sign.upper()
        signs.append(sign)
    return "".join(signs), counts


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def whole(conv_id: int | None, roles: list[str], texts: list[str], turns: list[int | None]) -> tuple:
    """The result row of a conversation held whole."""
    seen: set[tuple[str, str]] = set()
    repeats = []
    for row in zip(roles, texts):
        repeats.append(row in seen)
        seen.add(row)
    signs, counts = signs_of(roles, texts, repeats)
    cost, audit, _ = (search_short if len(signs) <= 32 else search)(signs)
    lines = repaired(audit, roles, texts)
    return (conv_id, gaps(turns), *counts, illegal(roles), cost, audit, sha256("\n".join(lines).encode()).hexdigest())


# ------------------------------------------------------------------------------------------- damage


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage; dropped ones stay as ``gone``, so that no conversation is lost.

    The remainder of crc32(conv_id:turn) by 20 decides; null ids, turns, roles and texts count as one blank.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


# ------------------------------------------------------------------------------------------ pieces


def _pieces(rows: DataFrame, most: int) -> DataFrame:
    """RESULT for conversations that begin and end inside a task, SEGMENT for pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nothing = TaskContext.get().partitionId(), object()
        conv, first, seg, size = nothing, True, 0, 0
        held: tuple[list, ...] = ([], [], [], [])
        done: list[tuple] = []

        def cut(open_: bool) -> None:
            nonlocal seg, size, held
            roles, texts, turns, marks = held
            if open_ or first or seg:
                done.append((*[conv, *[None] * 8], "" if conv is None else str(conv), part, seg, roles, texts, turns, marks))
            else:
                done.append((*whole(conv, roles, texts, turns), *[None] * 7))
            held, size, seg = ([], [], [], []), 0, seg + 1

        for batch in batches:
            for i, turn, role, text, gone, mark in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "mark"))):
                if i != conv:
                    if conv is not nothing:
                        cut(False)
                        first = False
                    conv, seg = i, 0
                if gone:
                    continue
                if len(held[0]) >= most or (held[0] and size + len(text) > SEGMENT_BYTES):
                    cut(True)
                for column, value in zip(held, (role, text, turn, mark)):
                    column.append(value)
                size += len(text)
            if done:
                yield _batch(done)
                done.clear()
        if conv is not nothing:
            cut(True)
            yield _batch(done)

    # A mark stands for role and text together; equal turns are ordered by role and mark, equal rows in any order.
    rows = rows.withColumn("mark", F.md5(F.concat_ws("\0", "role", "text").cast("binary")))
    rows = rows.repartitionByRange("conv_id", "turn", "role", "mark", F.rand(7)).sortWithinPartitions("conv_id", "turn", "role", "mark")
    return rows.mapInArrow(run, f"{RESULT}, {SEGMENT}")


_KINDS = [pa.int64()] * 7 + [pa.string()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*NAMES, *(c.split()[0] for c in SEGMENT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], names=names)


# ----------------------------------------------------- conversations over several pieces
PLACE = ["conv", "part", "seg"]


def _facts(pieces: DataFrame) -> DataFrame:
    """A row per piece: signs, counts, edge turns and roles, and the matrix of costs between roles."""
    shown = pieces.select(*PLACE, F.posexplode("marks").alias("at", "mark"))
    firsts = shown.groupBy("conv", "mark").agg(F.min(F.struct("part", "seg", "at")).alias("f"))
    news = firsts.groupBy("conv", F.col("f.part").alias("part"), F.col("f.seg").alias("seg")).agg(F.collect_list("f.at").alias("news"))
    joined = pieces.select("conv_id", *PLACE, "roles", "texts", "turns").join(news, PLACE, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                repeats = np.ones(len(r["roles"]), dtype=bool)
                repeats[r["news"] or []] = False
                signs, counts = signs_of(r["roles"], r["texts"], repeats.tolist())
                known = [t for t in r["turns"] if t is not None]
                numbers = [*counts, illegal(r["roles"]), len(set(known))]
                ends = [x[:1] for x in r["roles"][:1] + r["roles"][-1:]]
                row = (r["conv_id"], r["conv"], r["part"], r["seg"], signs, numbers, [*known[:1], *known[-1:]], ends, matrix(signs).ravel().tolist())
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    schema = "conv_id bigint, conv string, part int, seg int, signs string, numbers array<bigint>, turns array<bigint>, ends array<string>, costs array<bigint>"
    names = [c.split()[0] for c in schema.split(", ")]
    return joined.mapInArrow(run, schema)


def _follow(table: pa.Table) -> list[dict]:
    """A group's pieces in order."""
    return sorted(table.to_pylist(), key=lambda r: (r["part"], r["seg"]))


def _bounds(facts: DataFrame) -> DataFrame:
    """Per piece ``after``, the least cost of all later pieces by role, null for the last; on the first also the conversation's counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = _follow(table)
        total, last_turn, last_role, low, high = np.zeros(5, dtype=np.int64), None, None, None, None
        for r in rows:
            total += r["numbers"]
            if r["turns"]:
                total[4] -= r["turns"][0] == last_turn
                low, high, last_turn = (r["turns"][0] if low is None else low), r["turns"][-1], r["turns"][-1]
            if r["ends"]:
                total[3] += last_role is not None and last_role + r["ends"][0] not in LEGAL
                last_role = r["ends"][-1]
        afters, after = [], np.array(END)
        for r in reversed(rows):
            afters.append(after.tolist())
            after = (np.array(r["costs"]).reshape(4, 4) + after[None, :]).min(axis=1)
            # Inserts may stand before a piece as well; its first row's matrix has them, an empty piece changes nothing.
        afters[0] = None
        counts = [*total[:4].tolist(), 0 if low is None else high - low + 1 - int(total[4]), int(after[NONE])]
        out = [(r["conv"], r["part"], r["seg"], a, counts if not k else None) for k, (r, a) in enumerate(zip(rows, afters[::-1]))]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[*PLACE, "after", "counts"])

    return facts.select(*PLACE, "numbers", "turns", "ends", "costs").groupBy("conv").applyInArrow(run, "conv string, part int, seg int, after array<bigint>, counts array<bigint>")


def _audits(facts: DataFrame, limits: DataFrame) -> DataFrame:
    """Per piece the audit and last role for each role it may begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                found = [search(r["signs"], start, tuple(r["after"]) if r["after"] else None) for start in range(4)]
                row = (r["conv"], r["part"], r["seg"], [a for _, a, _ in found], [e for _, _, e in found])
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[*PLACE, "audits", "lasts"])

    rows = facts.select(*PLACE, "signs").join(limits.select(*PLACE, "after"), PLACE)
    return rows.mapInArrow(run, "conv string, part int, seg int, audits array<string>, lasts array<int>")


def _starts(audits: DataFrame) -> DataFrame:
    """Per piece the role that the conversation's edits have written before it."""

    def run(table: pa.Table) -> pa.Table:
        rows, role, starts = _follow(table), NONE, []
        for r in rows:
            starts.append(role)
            role = r["lasts"][role]
        return pa.table([pa.array([r["conv"] for r in rows]), *(pa.array([r[c] for r in rows], pa.int32()) for c in ("part", "seg")), pa.array(starts, pa.int32())], names=[*PLACE, "start"])

    return audits.select(*PLACE, "lasts").groupBy("conv").applyInArrow(run, "conv string, part int, seg int, start int")


def _finished(pieces: DataFrame, audits: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv, conv_id, audit, repaired_sha256): repaired pieces pass one after another through the hash of their conversation."""
    chosen = audits.join(starts, PLACE).select(*PLACE, "start", F.element_at("audits", F.col("start") + 1).alias("audit"))
    rows = pieces.select("conv_id", *PLACE, "roles", "texts").join(chosen, PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, conv_id, audit, hashed, begun = None, None, [], None, False

        def row() -> pa.RecordBatch:
            out = (conv, conv_id, "".join(audit), hashed.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["conv", "conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["conv"] != conv:
                    if hashed:
                        yield row()
                    conv, conv_id, audit, hashed, begun = r["conv"], r["conv_id"], [], sha256(), False
                audit.append(r["audit"])
                for line in repaired(r["audit"], r["roles"], r["texts"], r["start"]):
                    hashed.update(("\n" + line if begun else line).encode())
                    begun = True
        if hashed:
            yield row()

    ordered = rows.repartition("conv").sortWithinPartitions(*PLACE)
    return ordered.mapInArrow(run, "conv string, conv_id bigint, audit string, repaired_sha256 string")


def repair(rows: DataFrame, piece_rows: int = SEGMENT_ROWS) -> DataFrame:
    """RESULT for every conversation of rows (conv_id, turn, role, text, gone), as ``damage`` makes them.

    Rows are taken by turn (null first), equal turns by role and a digest of the text; equal rows count one after another, the later
    ones as duplicates. A conversation whose rows are all gone has zeros, an empty audit and the hash of an empty string; a null
    conv_id is a conversation. A role with another initial than s, u, a is never kept. An empty table gives no rows; further
    columns are left out. Very long texts are a piece each.
    """
    made = stored(_pieces(rows.select("conv_id", "turn", "role", "text", "gone"), piece_rows), "conversations")
    done, pieces = made.where("conv IS NULL").select(*NAMES), made.where("conv IS NOT NULL")
    facts = stored(_facts(pieces), "facts")
    limits = stored(_bounds(facts), "bounds")
    audits = stored(_audits(facts, limits), "audits")
    ends = _finished(pieces, audits, _starts(audits))
    counts = limits.where("counts IS NOT NULL").select("conv", "counts")
    at = [F.col("counts")[k] for k in (4, 0, 1, 2, 3, 5)]
    rest = ends.join(counts, "conv").select("conv_id", *[c.alias(n) for c, n in zip(at, NAMES[1:7])], "audit", "repaired_sha256")
    return done.unionByName(rest)


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text of every conversation after damage."""
    return repair(damage(rows))


ORACLE = f"""WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
hit AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')", "t")} % 20 AS kind
  FROM conversations, crc
), dmg AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text)) AS i FROM dmg
), judged AS MATERIALIZED (
  SELECT *, left(role, 1) AS own, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM placed
), ins(s, s1, ia, il, ic) AS (VALUES
  (0, 0, '', '', 0), (0, 2, 'I', 'user:' || chr(10), 5), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 10),
  (1, 1, '', '', 0), (1, 2, 'I', 'user:' || chr(10), 5), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 10),
  (2, 2, '', '', 0), (2, 3, 'I', 'assistant:' || chr(10), 5), (3, 3, '', '', 0), (3, 2, 'I', 'user:' || chr(10), 5)
), kept(s1, own, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edit AS (
  SELECT conv_id, i, s1, 'D' AS e, s1 AS t, 2 AS c, '' AS line FROM judged, (VALUES (0), (1), (2), (3)) AS q(s1)
  UNION ALL
  SELECT conv_id, i, s1, 'K', t, CASE fault WHEN 't' THEN 5 ELSE 0 END, role || ':' || text || chr(10) FROM judged JOIN kept USING (own) WHERE fault NOT IN ('b', 'd')
  UNION ALL
  SELECT conv_id, i, s1, 'R', CASE s1 WHEN 2 THEN 3 ELSE 2 END, CASE fault WHEN 't' THEN 6 ELSE 1 END,
         CASE s1 WHEN 2 THEN 'assistant:' ELSE 'user:' END || text || chr(10)
  FROM judged, (VALUES (0), (1), (2), (3)) AS q(s1) WHERE fault NOT IN ('b', 'd') AND own <> CASE s1 WHEN 2 THEN 'a' ELSE 'u' END
), way AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, struct_pack(c := CAST(0 AS BIGINT), a := '', r := '') AS w FROM placed
  UNION ALL
  SELECT y.conv_id, y.i + 1, e.t, min(struct_pack(c := y.w.c + n.ic + e.c, a := y.w.a || n.ia || e.e, r := y.w.r || n.il || e.line))
  FROM way y JOIN ins n ON n.s = y.s JOIN edit e ON e.conv_id IS NOT DISTINCT FROM y.conv_id AND e.i = y.i + 1 AND e.s1 = n.s1
  GROUP BY y.conv_id, y.i, e.t
), told AS MATERIALIZED (
  SELECT conv_id, max(i) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || own NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM judged GROUP BY conv_id
), best AS MATERIALIZED (
  SELECT y.conv_id, min(struct_pack(c := y.w.c + n.ic, a := y.w.a || n.ia, r := y.w.r || n.il)) AS w
  FROM way y JOIN told o ON o.conv_id IS NOT DISTINCT FROM y.conv_id AND o.n = y.i JOIN ins n ON n.s = y.s AND n.s1 IN (0, 3)
  GROUP BY y.conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(left(w.r, length(w.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id"""
