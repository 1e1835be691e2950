"""Conversation structure repair: the cheapest edits that make each conversation's roles alternate.

Rows are put in order once as slim rows without text, over range partitions, so a conversation may lie in
several. Blocks of consecutive rows are solved for each state that they may begin in (``turn_repair``), the
few numbers of a conversation's blocks give the states between them, and blocks write their rows' edits
from those, side by side. Texts move once, to be digested in order; a conversation's text is streamed, and
only its audit string and the numbers of its blocks are ever held whole.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import rows_of
from scorenet.llm.turn_repair import CODES, TAILS, Layers, edited, joined
from scorenet.storage import dropped, written

#: Rows of a block.
BLOCK = 4096
SPACE = " \t\n\x0b\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")

TURN = "conv_id long, turn long, role string, key binary"
BLOCKS = "conv_id long, part int, block long, pos long, first string, last string, blank long, duplicate long, truncated long, illegal long, ways string"
CODED = f"{TURN}, part int, pos long, code int"
#: What stands after a conversation's rows.
END = (None, None, "", None, None, None, None, None, "")
PATHS = "conv_id long, part int, block long, pos long, begin int, end int, blank long, duplicate long, truncated long, illegal long, cost long"


def batches_of(rows, schema: str | pa.Schema, size: int = 5000):
    """Arrow batches of tuples."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def stream(batches):
    for columns in rows_of(batches):
        yield from zip(*columns, strict=True)


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a null role or text as one space."""
    nil = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", nil).alias("role"), F.coalesce("text", nil).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the faults that a checksum of their place picks: of twenty cases 0 drops a row, 1
    empties its text, 2 takes its [.!?] away, 3 repeats it and 4 makes its role user."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(F.encode(name, "UTF-8")) % 20
    rows = turns.withColumn("_case", case).where("_case <> 0")
    rows = rows.withColumn("text", F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("_copy")).drop("_copy")


def keyed(turns: DataFrame) -> DataFrame:
    """With ``key``, the digest of conversation, role and text."""
    whole = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.octet_length("role").cast("string"), F.concat("role", "text"))
    return turns.withColumn("key", F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)))


def _number(batches):
    part, pos = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), *b.columns], names=["part", "pos", *b.schema.names])
        pos += n


def _solve(batches):
    """Each piece of a conversation in a block: its faults, its ends and its best ways from each state."""
    layers = Layers()

    def rows():
        for (part, block, conv), piece in groupby(stream(batches), lambda r: (r[0], r[1], r[3])):
            piece = list(piece)
            kinds = [(r[4], FAULTS[r[5]]) for r in piece]
            initials = [r[4] for r in piece]
            count = [sum(k[1] == f for k in kinds) for f in FAULTS[1:]]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            ways = json.dumps([layers.through(s, kinds) for s in range(4)])
            yield (conv, part, block, piece[0][2], initials[0], initials[-1], *count, illegal, ways)

    yield from batches_of(rows(), arrow_schema(BLOCKS))


def _join(batches):
    """The states that a conversation's pieces begin and end in; its sums stand at the first piece."""

    def rows():
        for conv, pieces in groupby(stream(batches), lambda r: r[0]):
            pieces = list(pieces)
            cost, states = joined([json.loads(p[10]) for p in pieces])
            illegal = sum(p[9] for p in pieces) + sum(a[5] + b[4] not in LEGAL for a, b in zip(pieces, pieces[1:]))
            sums = [sum(p[k] for p in pieces) for k in (6, 7, 8)]
            for k, p in enumerate(pieces):
                yield (conv, *p[1:4], states[k], states[k + 1], *((*sums, illegal, cost) if not k else [None] * 5))

    yield from batches_of(rows(), arrow_schema(PATHS))


def _write_codes(batches):
    """Edits of the rows of each piece, which its states come before."""
    layers = Layers()

    def rows():
        piece: list[tuple] = []
        states = (0, 0)

        def done():
            codes = layers.codes(*states, [(r[4], FAULTS[r[5]]) for r in piece]) if piece else []
            for r, code in zip(piece, codes, strict=True):
                yield (*r[6:10], r[0], r[2], code)

        for r in stream(batches):
            if r[3] == 0:
                yield from done()
                piece, states = [], r[10:12]
            else:
                piece.append(r)
        yield from done()

    yield from batches_of(rows(), arrow_schema(CODED))


def _digest(batches):
    """(conv_id, audit, repaired_sha256): the codes of equal rows come before those rows."""

    def rows():
        for conv, turns in groupby(stream(batches), lambda r: r[0]):
            state, audit, digest, lead, ready = 0, [], hashlib.sha256(), "", deque()
            for _, _, role, _, kind, _, _, code, text in chain(turns, [END]):
                if kind == 0:
                    ready.append(CODES[code])
                    continue
                audit.append(ready.popleft() if kind else TAILS[state])
                pieces, state = edited(state, audit[-1] if kind else f"{TAILS[state]}D", role, text)
                for p in pieces:
                    digest.update(f"{lead}{p}".encode("utf-8", "surrogatepass"))
                    lead = "\n"
            yield conv, "".join(audit), digest.hexdigest()

    yield from batches_of(rows(), arrow_schema("conv_id long, audit string, repaired_sha256 string"))


def repair(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text; damage them before, if that is
    wanted): conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows count by turn, nulls first, equal turns by role and then by a digest of the text;
    rows that are alike throughout stand side by side, and all but the first are duplicates. A null role or
    text is one space; a null conversation is one of its own. A row's first fault counts: blank (nothing
    but white space), duplicate (role and text seen before in the conversation), truncated (last other
    character not one of .!?). ``illegal`` counts neighbours whose roles' initials are not su, ua or au.
    ``audit`` has the initials of the cheapest edits (Keep 0, Rerole 2, Delete 3, Insert 2; one more for
    each truncated row that stays) that leave roles (s?(ua)+)?, ties the least string; blank and duplicate
    rows go. ``repaired_sha256`` digests the repaired role:text lines. An empty table gives no rows; other
    columns are not read."""
    turns = keyed(turns_of(rows))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = turns.select(
        "conv_id", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open")
    )
    order = ["conv_id", "turn", "role", "key"]
    kinds = f"part int, pos long, {TURN}, initial string, blank boolean, open boolean"
    slim = written(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, kinds), "turns")
    firsts = slim.where("not blank").groupBy("key").agg(F.min(F.struct("part", "pos")).alias("f")).select("f.part", "f.pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    marked = slim.join(firsts, ["part", "pos"], "left").select("part", F.floor(F.col("pos") / block_rows).alias("block"), "pos", F.lit(1).alias("kind"), "initial", fault.alias("fault"), *order)
    marked = written(marked, "marked")
    by_block = ["part", "block", "pos"]
    blocks = marked.select(*by_block, "conv_id", "initial", "fault").repartition("part", "block").sortWithinPartitions(*by_block).mapInArrow(_solve, BLOCKS)
    paths = written(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(_join, PATHS), "paths")
    states = paths.select(*by_block, F.lit(0).alias("kind"), "begin", "end")
    both = marked.unionByName(states, allowMissingColumns=True).repartition("part", "block").sortWithinPartitions(*by_block, "kind")
    codes = both.select(*by_block, "kind", "initial", "fault", *order, "begin", "end").mapInArrow(_write_codes, CODED)
    texts = turns.select(*order, F.lit(1).alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("code"), "text")
    codes = codes.select(*order, F.lit(0).alias("kind"), "part", "pos", "code", F.lit(None).cast("string").alias("text"))
    ends = codes.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order, "kind", "part", "pos")
    ends = written(ends.mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string"), "ends")
    sums = paths.where("cost is not null").select(F.col("conv_id").alias("_c"), "blank", "duplicate", "truncated", "illegal", "cost")
    out = ends.join(sums, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = written(out, "repaired")
    dropped(slim, marked, paths, ends)
    return out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    left = damaged(rows)
    turns = left.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    found = repair(left).join(turns.withColumnRenamed("conv_id", "_g"), F.col("conv_id").eqNullSafe(F.col("_g"))).withColumnRenamed("conv_id", "_f").drop("_g")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_f")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: Edits as strings, turn by turn, the checksum by list functions.
ORACLE = {
    "op13_conversation_repair": """
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM raw),
t AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM crc, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, sha256(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || octet_length(encode(role)) || ':' || role || text) AS key, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM t),
n AS (SELECT *, row_number() OVER w AS k, lag(role[1]) OVER w || role[1] AS pair FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY k) AS seen FROM n),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS dup, bare <> '' AND seen = 1 AND NOT regexp_matches(right(bare, 1), '[.!?]') AS trunc FROM s),
runs(a, q, ins, paid, words) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 2, ['user:']), (1, 3, 'II', 4, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 2, ['assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 2, ['user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
edits(q, edit, initial, b, named, paid2) AS (SELECT q, 'D', CAST(NULL AS VARCHAR), q, CAST(NULL AS VARCHAR), 3 FROM range(4) r(q) UNION ALL SELECT * FROM (VALUES (0, 'K', 's', 1, CAST(NULL AS VARCHAR), 0), (0, 'K', 'u', 2, NULL, 0), (1, 'K', 'u', 2, NULL, 0), (3, 'K', 'u', 2, NULL, 0), (2, 'K', 'a', 3, NULL, 0),
  (0, 'R', CAST(NULL AS VARCHAR), 2, 'user', 2), (1, 'R', NULL, 2, 'user', 2), (3, 'R', NULL, 2, 'user', 2), (2, 'R', NULL, 3, 'assistant', 2))),
moves AS (SELECT a, b, ins || edit AS code, edit, initial, named, paid + paid2 AS paid, words FROM runs JOIN edits USING (q)),
r(conv_id, k, state, cost, audit, said) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', []::VARCHAR[] FROM f
  UNION ALL
  SELECT conv_id, k, state, best.cost, best.audit, best.said FROM (
    SELECT r.conv_id, f.k, m.b AS state, min({'cost': r.cost + m.paid + CASE WHEN f.trunc AND m.edit <> 'D' THEN 1 ELSE 0 END, 'audit': r.audit || m.code,
      'said': list_concat(r.said, m.words, CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.named || ':' || f.text] END)}) AS best
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1
    JOIN moves m ON m.a = r.state AND (m.edit = 'D' OR NOT (f.blank OR f.dup)) AND (m.initial IS NULL OR m.initial = f.role[1])
    GROUP BY r.conv_id, f.k, m.b)),
last AS (SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
ends AS (SELECT r.conv_id, min({'cost': r.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': r.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
  'said': list_concat(r.said, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS best
  FROM r JOIN last ON last.conv_id IS NOT DISTINCT FROM r.conv_id AND last.n = r.k GROUP BY r.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
}
