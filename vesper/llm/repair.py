r"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

``damaged`` breaks rows by a hash of their place; ``plan`` finds faults and edits; ``repaired`` has the rows after the edits.

Rows that are equal in a conversation are one row with a number of copies, and a row of the same role and text at a later turn is
a duplicate, by a pre-aggregated join. Rows are collected by (conversation, SEGMENT turns), so that no conversation is
in one group. Each segment's sorted rows are folded by ``aggregate``, from each of the four states that a conversation can be in (nothing
yet, after s, after u, after a), into four (cost, audit) structs, one for the state after it: a row is kept, given
another role or deleted, with roles put in before it, and the ``least`` struct of each state goes on. Costs, then audits, compare as structs do;
both orders survive what is appended, so a state's least struct is all that it needs. A second fold joins a conversation's segments: texts
never take part in it, only an audit letter a row. Faults, folds and edits are built-in functions only. Texts are merged with their edits in
order, in Arrow batches, so that they are dealt once; the digest of a repaired conversation (``digests``),
which SHA-256 makes sequential, reads the rows of a conversation, in order, in one task in bounded memory.

Inside, letters name an edit's role too: I and J put in user and assistant, R and S give these roles, K keeps, D deletes; these four
pairs are never alternatives after equal beginnings, so audits compare as with I and R alone. A row's further copies can only be deleted;
their D follow its letter in the audit.

Order is by turn, without one first, then by role and the text's SHA-256. Null roles and texts are one space; a conversation without an id is one
conversation. Conversations that lose all rows have zeros, an empty audit and no rows; an empty table gives empty ones. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

#: Turns whose rows are collected together.
SEGMENT = 256
#: What edits cost, and bytes that are no text.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: What audits show of the letters.
SHOWN = {"K": "K", "R": "R", "S": "R", "I": "I", "J": "I"}
#: More than any conversation's edits cost.
NEVER = 1 << 50

REPAIRED, DIGESTS = "conv_id long, segment long, nth long, role string, text string, edit string", "conv_id long, repaired_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies), nulls of role and text as one space."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).cast("long").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """turns() with one row in four broken, by crc32 of "conv_id:turn" modulo 20; rows that it drops have no copies."""
    place = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])
    rows = turns(conversations).withColumn("_code", F.crc32(F.encode(place, "utf-8")) % 20)
    text = F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _place(turn: str = "turn") -> Column:
    """Orders turns, without one first."""
    return F.struct(F.col(turn).isNotNull().alias("there"), F.col(turn).alias("turn"))


def _said() -> Column:
    return F.unhex(F.sha2("text", 256))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, said = text's SHA-256) with their copies (0: none is left), whether they are blank, truncated, or the first of their role and text."""
    blank = F.length(F.trim("text", F.lit(BLANKS))) == 0
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", _said().alias("said"), "copies", blank.alias("blank"), (~blank & ~end.isin(".", "!", "?")).alias("truncated"))
    slim = slim.groupBy("conv_id", "turn", "role", "said").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    first = slim.where("copies > 0").groupBy("conv_id", "role", "said").agg(F.min(_place()).alias("_first"))
    a, b = slim.alias("a"), first.alias("b")
    met = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.said") == F.col("b.said")), "left")
    return met.select("a.*", F.coalesce(F.col("b._first.turn").eqNullSafe(F.col("a.turn")), F.lit(False)).alias("first"))


def _state(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def _then(state: Column, cost, letters) -> Column:
    """A state after edits."""
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letters).alias("audit"))


def _four(*states: Column) -> Column:
    return F.struct(*[s.alias(f"q{i}") for i, s in enumerate(states)])


def _opened(a: Column) -> Column:
    """The states with what may be put in before the next row."""
    one, both = F.lit(INSERT), F.lit(2 * INSERT)
    q2 = F.least(a["q2"], *[_then(a[q], one, "I") for q in ("q0", "q1", "q3")])
    q3 = F.least(a["q3"], _then(a["q2"], one, "J"), *[_then(a[q], both, "IJ") for q in ("q0", "q1")])
    return _four(a["q0"], a["q1"], q2, q3)


def _row(a: Column, row: Column) -> Column:
    """The states after a row."""
    more = F.lit(DELETE) * (row["copies"] - 1) + F.when(row["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
    gone, never = F.lit(DELETE) * row["copies"], _state(NEVER, "")

    def stays(state: Column, initial: str, other: str) -> Column:
        """Kept with the role that is due, or given it."""
        kept = row["initial"] == initial
        return _let(state, lambda s: _then(s, more + F.when(kept, F.lit(0)).otherwise(F.lit(REROLE)), F.when(kept, F.lit("K")).otherwise(F.lit(other))))

    def free(state: Column) -> Column:
        return F.when(row["free"], state).otherwise(never)

    q1 = F.least(_then(a["q1"], gone, "D"), F.when(row["free"] & (row["initial"] == "s"), _then(a["q0"], more, "K")).otherwise(never))
    q2 = F.least(_then(a["q2"], gone, "D"), free(stays(F.least(a["q0"], a["q1"], a["q3"]), "u", "R")))
    q3 = F.least(_then(a["q3"], gone, "D"), free(stays(a["q2"], "a", "S")))
    return _four(_then(a["q0"], gone, "D"), q1, q2, q3)


def _folded(rows: Column, start: int) -> Column:
    begin = _four(*[_state(0 if q == start else NEVER, "") for q in range(4)])
    return F.aggregate(rows, begin, lambda a, row: _let(_opened(a), lambda o: _row(o, row)))


def segments(found: DataFrame) -> DataFrame:
    """Segments of faults(): their rows in order, counts, and the four structs from each state (``ways``)."""
    row = F.struct(
        _place().alias("place"), "role", "said", "copies", "truncated", "blank", (F.col("first") & ~F.col("blank")).alias("free"), F.left("role", F.lit(1)).alias("initial"),
    )
    segment = F.floor(F.col("turn") / F.lit(SEGMENT)).cast("long")
    made = found.withColumn("segment", segment).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, row))).alias("rows"))
    rows, n = F.col("rows"), F.size("rows")

    def total(value: Callable[[Column], Column], of: Column = rows) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + value(x).cast("long"))

    pairs = F.when(n > 1, F.zip_with(F.slice(rows, 1, n - 1), F.slice(rows, 2, n - 1), lambda x, y: F.concat(x["initial"], y["initial"])))
    times = F.filter(F.transform(rows, lambda r: r["place"]["turn"]), lambda t: t.isNotNull())
    return made.select(
        "conv_id", "segment", "rows",
        total(lambda r: F.when(r["blank"], r["copies"]).otherwise(F.lit(0))).alias("blank"),
        total(lambda r: F.when(r["blank"], F.lit(0)).otherwise(r["copies"] - r["free"].cast("long"))).alias("duplicate"),
        total(lambda r: r["free"] & r["truncated"]).alias("truncated"),
        (total(lambda r: r["copies"] - 1) + F.coalesce(total(lambda p: ~p.isin("su", "ua", "au"), pairs), F.lit(0))).alias("illegal"),
        F.array_min(times).alias("least"), F.array_max(times).alias("most"), F.size(F.array_distinct(times)).cast("long").alias("turns"),
        F.array(*[_folded(rows, q) for q in range(4)]).alias("ways"),
    )


def _joined(parts: Column) -> Column:
    """A conversation's segments, in order, as one fold: the least (cost, audit) of each state, with the audit's part of each segment."""

    def state(q: int) -> Column:
        return F.struct(F.lit(0 if q == 0 else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, part: Column) -> Column:
        def to(q: int) -> Column:
            ways = [(a[f"q{p}"], part["ways"][p][f"q{q}"]) for p in range(4)]
            return F.least(*[F.struct(F.least(s["cost"] + w["cost"], F.lit(NEVER)).alias("cost"), F.concat(s["audit"], w["audit"]).alias("audit"), F.concat(s["parts"], F.array(w["audit"])).alias("parts")) for s, w in ways])

        return _four(*[to(q) for q in range(4)])

    return F.aggregate(parts, _four(*[state(q) for q in range(4)]), step)


def _edits(part: Column, copies: Column) -> Column:
    """What an audit's part says of each of its rows (``before``, ``edit``), and the letters that public audits show."""
    words = F.regexp_extract_all(part, F.lit("([IJ]*[DKRS])"), 1)
    return F.zip_with(words, copies, lambda w, n: F.concat(F.translate(w, "JS", "IR"), F.repeat(F.lit("D"), (n - 1).cast("int"))))


def plan(parts: DataFrame) -> DataFrame:
    """A row per conversation of segments(): gaps, counts of faults, cost, audit; and its segments with their parts of the inner audit."""
    slim = F.struct(
        F.struct(F.col("segment").isNotNull().alias("there"), F.col("segment").alias("segment")).alias("place"), "ways", F.transform("rows", lambda r: r["copies"]).alias("copies"),
        F.when(F.size("rows") > 0, F.get("rows", 0)["initial"]).alias("head"), F.when(F.size("rows") > 0, F.element_at("rows", -1)["initial"]).alias("tail"),
    )
    sums = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "turns")]
    rows = parts.groupBy("conv_id").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), F.sort_array(F.collect_list(slim)).alias("parts"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: F.size(p["copies"]) > 0)).withColumn("n", F.size("parts")).withColumn("ends", _joined(F.col("parts")))

    def ended(q: str, cost: int, tail: str) -> Column:
        s = F.col(f"ends.{q}")
        return F.struct((s["cost"] + cost).alias("cost"), F.concat(s["audit"], F.lit(tail)).alias("audit"), s["parts"].alias("parts"), F.lit(tail).alias("tail"))

    rows = rows.withColumn("best", F.least(ended("q0", 0, ""), ended("q3", 0, ""), ended("q2", INSERT, "J"), ended("q1", 2 * INSERT, "IJ")))
    across = F.when(F.col("n") > 1, F.zip_with(F.slice("parts", 1, F.col("n") - 1), F.slice("parts", 2, F.col("n") - 1), lambda x, y: F.concat(x["tail"], y["head"]).isin("su", "ua", "au")))
    shown = F.array_join(F.zip_with("parts", "best.parts", lambda p, a: F.array_join(_edits(a, p["copies"]), "")), "")
    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(F.lit(0))
    last = F.col("n") - 1
    slices = F.zip_with("parts", "best.parts", lambda p, a: F.struct(p["place"]["segment"].alias("segment"), a.alias("part"), (p["place"] == F.get("parts", last)["place"]).alias("last")))
    return rows.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.coalesce(F.size(F.filter(across, lambda ok: ~ok)), F.lit(0))).alias("illegal"),
        F.col("best.cost").alias("cost"), F.concat(shown, F.translate("best.tail", "J", "I")).alias("audit"),
        F.transform(slices, lambda s: F.struct(s["segment"].alias("segment"), s["part"].alias("part"), F.when(s["last"], F.col("best.tail")).otherwise(F.lit("")).alias("tail"))).alias("slices"),
    )


def edits(parts: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, segment, turn, role, said, word) of every distinct row that isn't just deleted: its letters, with those put in around it."""
    slices = plans.select("conv_id", F.inline("slices")).alias("b")
    a = parts.select("conv_id", "segment", "rows").alias("a")
    met = a.join(slices, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.segment").eqNullSafe(F.col("b.segment")))
    words = F.regexp_extract_all("part", F.lit("([IJ]*[DKRS])"), 1)
    each = met.select("a.conv_id", "a.segment", "tail", F.size("rows").alias("n"), F.posexplode(F.arrays_zip(words.alias("word"), F.col("a.rows").alias("row"))).alias("nth", "x"))
    word = F.concat(F.col("x.word"), F.when(F.col("nth") == F.col("n") - 1, F.col("tail")).otherwise(F.lit("")))
    return each.select("conv_id", "segment", F.col("x.row.place.turn").alias("turn"), F.col("x.row.role").alias("role"), F.col("x.row.said").alias("said"), word.alias("word")).where("word <> 'D'")


def repaired(rows: DataFrame, parts: DataFrame, plans: DataFrame, whole: bool = False) -> DataFrame:
    """(conv_id, segment, nth, role, text, edit) of every row after the edits, in order by segment and nth; edit is K, R or I.

    Texts are dealt once, to the edits of their segment, and both are merged in order; ``whole``: to those of their conversation, whose rows
    then come one after the other in one task, for what reads them so.
    """
    words = edits(parts, plans).withColumn("text", F.lit(None).cast("string"))
    segment = F.floor(F.col("turn") / F.lit(SEGMENT)).cast("long").alias("segment")
    texts = rows.where("copies > 0").select("conv_id", segment, "turn", "role", _said().alias("said"), F.lit(None).cast("string").alias("word"), "text")
    keys = ["conv_id"] if whole else ["conv_id", "segment"]
    both = words.union(texts).repartition(*keys).sortWithinPartitions("conv_id", "segment", "turn", "role", "said", F.col("word").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nth, due = None, 0, None  # due: the row that the next text is of, and its letters
        for batch in batches:
            out = []
            for conv, part, turn, role, said, word, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "turn", "role", "said", "word", "text")), strict=True):
                if (conv, part) != place:
                    place, nth = (conv, part), 0
                if word is not None:
                    due = (conv, turn, role, said), word
                elif due is not None and due[0] == (conv, turn, role, said):  # its further copies are deleted
                    for letter in due[1]:
                        if letter != "D":
                            out.append((conv, part, nth, role if letter == "K" else "user" if letter in "IR" else "assistant", "" if letter in "IJ" else text, SHOWN[letter]))
                            nth += 1
                    due = None
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in REPAIRED.split(", ")])
            batch = out = None
            frames.tidy()

    return both.mapInArrow(run, REPAIRED)


def digests(made: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations that repaired(whole=True) has rows of: "role:text" by lines, read as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, digest, done = None, False, None, []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv, role, said in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append((now, digest.hexdigest()))
                    now, begun, digest = conv, True, hashlib.sha256(f"{role}:{said}".encode())
                else:
                    digest.update(f"\n{role}:{said}".encode())
            if done:
                yield table()
                done = []
        if begun:
            done.append((now, digest.hexdigest()))
            yield table()

    return made.select("conv_id", "role", "text").mapInArrow(run, DIGESTS)


def repair(rows: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of turns() or damaged(): plan() (a row per conversation) and repaired() (a row per turn after the edits)."""
    parts = frames.keep(segments(faults(rows)), "segments")
    plans = frames.keep(plan(parts), "plans")
    return plans, repaired(rows, parts, plans, whole)


def report(plans: DataFrame, made: DataFrame) -> DataFrame:
    """A row per conversation: plan()'s figures, and the digest of its rows after the edits, which are whole conversations in order."""
    found = digests(made).alias("d")
    met = plans.drop("slices").alias("p").join(found, F.col("p.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return met.select("p.*", F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """report(*repair(damaged(conversations))) by DuckDB. A state is a string: its cost in twelve digits, then its audit."""

    def then(state: str, cost: str | int, letters: str) -> str:
        return f"(lpad((({state})[1:12]::bigint + {cost})::varchar, 12, '0') || ({state})[13:] || {letters})"

    never, more = "'900000000000'", f"case when x.truncated then {TRUNCATED} else 0 end"
    due = "least(a.q0, a.q1, a.q3)"

    def fields(q0: str, q1: str, q2: str, q3: str) -> str:
        return f"{{'q0': {q0}, 'q1': {q1}, 'q2': {q2}, 'q3': {q3}, 'gap': true, 'initial': '', 'free': false, 'truncated': false}}"

    def stays(state: str, initial: str, other: str) -> str:
        return f"case when not x.free then {never} when x.initial = '{initial}' then {then(state, more, repr('K'))} else {then(state, f'{more} + {REROLE}', repr(other))} end"

    opened = fields(
        "a.q0", "a.q1", "least(a.q2, " + ", ".join(then(f"a.{q}", INSERT, "'I'") for q in ("q0", "q1", "q3")) + ")",
        f"least(a.q3, {then('a.q2', INSERT, repr('J'))}, " + ", ".join(then(f"a.{q}", 2 * INSERT, "'IJ'") for q in ("q0", "q1")) + ")",
    )
    gone = [then(f"a.q{i}", DELETE, "'D'") for i in range(4)]
    system = f"case when x.free and x.initial = 's' then {then('a.q0', more, repr('K'))} else {never} end"
    row = fields(gone[0], f"least({gone[1]}, {system})", f"least({gone[2]}, {stays(due, 'u', 'R')})", f"least({gone[3]}, {stays('a.q2', 'a', 'S')})")
    begin = fields("'000000000000'", never, never, never)
    gap = fields("''", "''", "''", "''")
    return rf"""
with crc as (select list(c order by i) as crcs from (select i, list_reduce(range(8), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), i) as c from range(256) t(i))),
plain as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place from conversations),
coded as (select *, xor(list_reduce(list_transform(string_split(place, ''), lambda x: ord(x)::bigint), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as code from plain, crc),
broken as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded, range(2) copies(copy) where code <> 0 and (copy = 0 or code = 3)
), placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as nth from broken),
marked as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by nth) > 1 as seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as cut, lag(left(role, 1)) over (partition by conv_id order by nth) || left(role, 1) as pair from placed
), folded as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (seen and not blank) as duplicate,
    count(*) filter (cut and not blank and not seen) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, list({{'role': role, 'text': text}} order by nth) as said,
    list_reduce(flatten(list([{gap}, {gap.replace("'gap': true", "'gap': false").replace("'initial': ''", "'initial': left(role, 1)").replace("'free': false", "'free': not blank and not seen").replace("'truncated': false", "'truncated': cut")}] order by nth)) || [{gap}],
      lambda a, x: case when x.gap then {opened} else {row} end, {begin}) as ends
  from marked group by conv_id
), chosen as (select *, least(ends.q0, ends.q3) as best from folded),
worded as (select *, best[13:] as audit_, regexp_extract_all(best[13:], '[IJ]*[DKRS]') as words, regexp_extract(best[13:], '[IJ]*$') as tail from chosen),
lined as (
  select *, flatten(list_transform(list_zip(words, said), lambda z: list_transform(string_split(z[1], ''), lambda c: case c when 'I' then 'user:' when 'J' then 'assistant:'
    when 'K' then z[2].role || ':' || z[2].text when 'R' then 'user:' || z[2].text when 'S' then 'assistant:' || z[2].text end)))
    || list_transform(string_split(tail, ''), lambda c: case c when 'I' then 'user:' when 'J' then 'assistant:' end) as lines from worded
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best[1:12]::bigint, 0) as cost, coalesce(translate(audit_, 'JS', 'IR'), '') as audit, sha256(coalesce(array_to_string(list_filter(lines, lambda l: l is not null), chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join lined l on o.conv_id is not distinct from l.conv_id
"""


ORACLE = _oracle()
