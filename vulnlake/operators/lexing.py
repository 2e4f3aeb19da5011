"""Strings, comments and parentheses over lines: what a line starts in, and the statements that lines make up.

A line is a map from the state it starts in (code, a string of either kind, a block comment) to the state it ends in. Such
maps compose, so the state at any line is a prefix scan: chunks of lines are folded on their own, the chunks' maps the same
way, and the states found go back down. No task sees more than ``CHUNK`` lines of a file at once, however long it is.

A statement is a run of lines between places outside all parentheses. A file that never closes a parenthesis would be one
run, so a line that begins a named function, class or namespace always begins a statement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.ordered import dealt, hot_keys, running
from vulnlake.session import durable

FILE = ["project", "path"]
CODE, SINGLE, DOUBLE, BLOCK = range(4)
#: The map that keeps each state: two bits per state, the lowest for CODE.
IDENTITY = 0b11_10_01_00
#: Lines per chunk (a power of two), and chunks per block.
CHUNK, BLOCKS = 7, 10

QUOTED = {SINGLE: r"[^'\\]*(?:\\.[^'\\]*)*", DOUBLE: r"[^\x22\\]*(?:\\.[^\x22\\]*)*"}
STRING = rf"'{QUOTED[SINGLE]}'|\x22{QUOTED[DOUBLE]}\x22"
#: A string that the line does not end.
OPEN_STRING = rf"'{QUOTED[SINGLE]}\\?$|\x22{QUOTED[DOUBLE]}\\?$"
LINE_COMMENT = r"//.*$|#(?:[^\[].*)?$"
BLOCK_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
COMMENTS = rf"({STRING}|{OPEN_STRING})|{LINE_COMMENT}|{BLOCK_COMMENT}|/\*.*$"
DEFINITION = r"function\s+&?\w+\s*\("
BEGINS = r"^\s*(?:(?:abstract|final|public|protected|private|static|readonly)\s+)*(?:function\s+&?\w+\s*\(|(?:class|interface|trait)\s+\w+|namespace\s+[\w\\]+\s*[;{])"


def let(value: Column, body) -> Column:
    """``body(value)``, evaluated as it stands and not compiled into the plan's code, which it would make too large."""
    return F.transform(F.array(value), body)[0]


def _end_of(text: Column) -> Column:
    """State after a text that starts in code: what is left of it opens with the mark that nothing closes."""
    rest = F.regexp_replace(text, rf"{STRING}|{LINE_COMMENT}|{BLOCK_COMMENT}", " ")
    mark = F.translate(F.substring(F.regexp_extract(rest, r"['\x22]|/\*", 0), 1, 1), "'\"/", f"{SINGLE}{DOUBLE}{BLOCK}")
    return F.coalesce(mark.try_cast("int"), F.lit(CODE))


def _end_in_code(text: Column) -> Column:
    return F.when(text.rlike(r"['\x22]|/\*"), _end_of(text)).otherwise(CODE)


def _resumed(text: Column, state: int) -> Column:
    """What follows the end of the string or comment that a text starts in."""
    return F.regexp_replace(text, r"^.*?\*/" if state == BLOCK else rf"^{QUOTED[state]}{chr(39) if state == SINGLE else chr(34)}", "")


def _end_from(text: Column, state: int) -> Column:
    """State after a text that starts inside a string or comment."""
    rest = let(_resumed(text, state), lambda r: F.when(F.length(r) < F.length(text), _end_in_code(r)).otherwise(state))
    return F.when(text.contains({SINGLE: "'", DOUBLE: '"', BLOCK: "*/"}[state]), rest).otherwise(state)


def line_map(text: Column) -> Column:
    full = lambda t: _end_in_code(t) + _end_from(t, SINGLE) * 4 + _end_from(t, DOUBLE) * 16 + _end_from(t, BLOCK) * 64
    return F.when(text.rlike(r"['\x22]|/\*|\*/"), let(text, full)).otherwise(IDENTITY)


def step(state: Column, line: Column) -> Column:
    """State after a line (its map) that starts in a state."""
    return F.call_function("shiftright", line, state * 2).bitwiseAND(F.lit(3))


def _total(units: Column) -> Column:
    ends = [F.aggregate(units, F.lit(s), lambda a, u: step(a, u["map"])) for s in range(4)]
    return ends[0] + ends[1] * 4 + ends[2] * 16 + ends[3] * 64


def _walked(units: Column, state: Column) -> Column:
    """(no, state it starts in) of each unit in order."""
    first = F.struct(state.alias("state"), F.array().cast("array<struct<no:bigint,state:int>>").alias("out"))
    return F.aggregate(units, first, lambda a, u: F.struct(
        step(a["state"], u["map"]).alias("state"), F.concat(a["out"], F.array(F.struct(u["no"].alias("no"), a["state"].alias("state")))).alias("out")), lambda a: a["out"])


def _states(units: DataFrame, shifts: list[int]) -> DataFrame:
    """(file, no, state) of units (file, no, map): folded in groups of 2**shift, the groups' own states found first."""
    row = F.array_sort(F.collect_list(F.struct("no", "map"))).alias("units")
    if not shifts:
        whole = units.groupBy(*FILE).agg(row)
        return whole.select(*FILE, F.explode(_walked(F.col("units"), F.lit(CODE))).alias("u")).select(*FILE, "u.*")
    # read by both sides of the join below, and above by two more: maps are worked out once
    groups = durable(units.groupBy(*FILE, F.shiftright("no", shifts[0]).alias("group")).agg(row))
    above = _states(groups.select(*FILE, F.col("group").alias("no"), _total(F.col("units")).alias("map")), shifts[1:])
    found = groups.join(above.withColumnRenamed("no", "group"), [*FILE, "group"])
    return found.select(*FILE, F.explode(_walked(F.col("units"), F.col("state"))).alias("u")).select(*FILE, "u.*")


def start_states(lines: DataFrame) -> DataFrame:
    """(file, line, lex_in) of the lines that start inside a string or comment."""
    units = lines.select(*FILE, F.col("line").cast("long").alias("no"), line_map(F.col("text")).alias("map"))
    return _states(units, [CHUNK, BLOCKS]).where(F.col("state") != CODE).select(*FILE, F.col("no").cast("int").alias("line"), F.col("state").alias("lex_in"))


def code_lines(lines: DataFrame) -> DataFrame:
    """Add ``code``: the line without comments, strings that go on over lines closed at its end and opened again; and the
    states ``lex_in`` and ``lex_out`` that it starts and ends in."""
    # Lexing is the dear part: blocks of lines are dealt out for it, however few splits the source has.
    lines = dealt(lines, *FILE, F.shiftright("line", CHUNK + BLOCKS))
    states = start_states(lines).select(*[F.col(c).alias(f"_{c}") for c in (*FILE, "line")], "lex_in")
    same = (F.col("project").eqNullSafe(F.col("_project"))) & (F.col("path").eqNullSafe(F.col("_path"))) & (F.col("line") == F.col("_line"))
    rows = lines.join(states, same, "left").drop("_project", "_path", "_line").withColumn("lex_in", F.coalesce("lex_in", F.lit(CODE)))

    def read(x: Column) -> Column:
        text, state = x["text"], x["state"]
        body = (F.when(state == BLOCK, F.when(text.contains("*/"), _resumed(text, BLOCK)).otherwise("")).when(state == SINGLE, F.concat(F.lit("'"), text))
                .when(state == DOUBLE, F.concat(F.lit('"'), text)).otherwise(text))
        kept = let(body, lambda b: F.when(b.rlike(r"//|#|/\*"), F.regexp_replace(b, COMMENTS, "$1")).otherwise(b))
        end = F.when(state == CODE, _end_in_code(text)).when(state == SINGLE, _end_from(text, SINGLE)).when(state == DOUBLE, _end_from(text, DOUBLE)).otherwise(_end_from(text, BLOCK))
        return let(end, lambda e: F.struct(F.concat(kept, F.when(e == SINGLE, F.lit("'")).when(e == DOUBLE, F.lit('"')).otherwise("")).alias("code"), e.cast("int").alias("lex_out")))

    # a generator: conditions on the code are not pushed below it, where each mention would read the line again
    return rows.select("*", F.inline(F.transform(F.array(F.struct("text", F.col("lex_in").alias("state"))), read)))


def count_of(code: Column, ch: str) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit(ch), F.lit("")))


def opened(code: Column) -> Column:
    """Parentheses that a line opens more than it closes, strings left out."""
    bare = F.when(code.rlike(r"['\x22]"), F.regexp_replace(code, STRING, "")).otherwise(code)
    return F.when(code.contains("(") | code.contains(")"), count_of(bare, "(") - count_of(bare, ")")).otherwise(0)


def ending() -> Column:
    """(line, name it ends with) of a line that is not blank."""
    return F.when(F.col("code").rlike(r"\S"), F.struct("line", F.regexp_extract("code", r"([\w$>:-]*)\s*$", 1).alias("name")))


def receiver(last: str) -> Column:
    """What a call that opens a line is called on: the end of the line before, if the line goes on with it."""
    return F.when(F.col("code").rlike(r"^\s*(?:\?->|->|::)"), F.col(f"{last}.name"))


def statement_lines(lines: DataFrame, hot=True) -> DataFrame:
    """Add ``stmt``, the first line of the line's statement, ``lone``, whether it is the only one, and ``prev`` (``receiver``)."""
    hot = hot_keys(lines, FILE) if hot is True else hot
    rows = running(lines.withColumn("_open", opened(F.col("code"))), FILE, ["line"], {"_depth": ("sum", F.col("_open")), "_last": ("max", ending())}, inclusive=False, hot=hot)
    rows = rows.withColumn("_depth", F.coalesce("_depth", F.lit(0))).withColumn("prev", receiver("_last"))
    begins = F.when(F.col("code").rlike(BEGINS), F.struct("line", "_depth"))
    rows = running(rows, FILE, ["line"], {"_base": ("max", begins)}, hot=hot)
    rows = rows.withColumn("_depth", F.col("_depth") - F.coalesce("_base._depth", F.lit(0)))
    rows = running(rows, FILE, ["line"], {"stmt": ("max", F.when(F.col("_depth") <= 0, F.col("line")))}, hot=hot)
    rows = rows.withColumn("stmt", F.coalesce("stmt", "line"))
    return rows.withColumn("lone", (F.col("stmt") == F.col("line")) & (F.col("_depth") + F.col("_open") <= 0)).drop("_open", "_depth", "_base", "_last")


def statements(lines: DataFrame, facts: list[str]) -> DataFrame:
    """project, path, text and ``lines`` (line and facts of each of its lines) of every statement of ``statement_lines``.

    Statements of one line pass; the others are gathered, none larger than what lies between two definitions."""
    fact = F.struct("line", *facts)
    first = F.when(F.col("lex_in").isin(SINGLE, DOUBLE), 2).otherwise(1)
    size = F.length("code") - first + 1 - F.when(F.col("lex_out").isin(SINGLE, DOUBLE), 1).otherwise(0)
    piece = F.substring(F.col("code"), first, size)
    one = lines.where("lone").select(*FILE, F.col("code").alias("text"), F.array(fact).alias("lines"))
    many = lines.where("NOT lone").groupBy(*FILE, "stmt").agg(F.array_sort(F.collect_list(F.struct("line", piece.alias("piece"), fact.alias("fact")))).alias("l"))
    many = many.select(*FILE, F.array_join(F.transform("l", lambda x: x["piece"]), "\n").alias("text"), F.transform("l", lambda x: x["fact"]).alias("lines"))
    return one.unionByName(many)


TOKENS = re.compile(rf"'{QUOTED[SINGLE]}'?|\x22{QUOTED[DOUBLE]}\x22?|(?<![\w$])function[ \t]+&?\w+[ \t]*\(|((?:->|::|\$)?[A-Za-z_]\w*)[ \t]*\(|[()\[\]{{}},\n]", re.S)
PAIRS = {")": "(", "]": "[", "}": "{"}
NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$>:-")


def calls_in(text: str) -> list[tuple[int, str, str, list[str], list[str]]]:
    """(line within the text, token, what stands right before it, arguments, arguments without strings and nested groups).

    One pass over the tokens with a stack of open groups: arguments nest to any depth."""
    calls, stack, row = [], [], 0  # stack: [opening mark, call or None, start of the argument, start of its outer text, outer text]

    def finish(group: list, at: int) -> None:
        value = text[group[2] : at].strip()
        if value:
            group[1][3].append(re.sub(r"\s*\n\s*", " ", value) if "\n" in value else value)
            group[1][4].append(group[4] + text[group[3] : at])
        group[2], group[3], group[4] = at + 1, at + 1, ""

    for m in TOKENS.finditer(text):
        token, at, end = m.group(), m.start(), m.end()
        top, last = stack[-1] if stack else None, token[-1]
        if token == "\n":
            row += 1
        elif token[0] in "'\"":
            row += token.count("\n")
            if top and top[1]:
                top[4], top[3] = top[4] + text[top[3] : at] + "''", end
        elif last in "([{":
            if top and top[1]:
                top[4] += text[top[3] : end - 1]
            call = None
            if m.group(1):
                k = at
                if token[0] in "-:":
                    while k and text[k - 1].isspace():
                        k -= 1
                stop = k
                while k and text[k - 1] in NAME:
                    k -= 1
                call = (row, m.group(1), text[k:stop], [], [])
                calls.append(call)
            stack.append([last, call, end, end, ""])
        elif token == ",":
            if top and top[1]:
                finish(top, at)
        elif any(g[0] == PAIRS[token] for g in stack):
            while stack:
                group = stack.pop()
                if group[1]:
                    finish(group, at)
                if group[0] == PAIRS[token]:
                    break
            if stack:
                stack[-1][3] = end
    for group in reversed(stack):
        if group[1]:
            finish(group, len(text))
    return calls


def calls_of(units: DataFrame) -> DataFrame:
    """A row per call of statements: the columns of ``units`` without text, and row, seq, token, before, args, outers."""
    keep = [c for c in units.columns if c != "text"]
    fields = units.select(*keep).schema.simpleString()[len("struct<") : -1]
    kinds = [("row", pa.int32()), ("seq", pa.int32()), ("token", pa.string()), ("before", pa.string()), ("args", pa.list_(pa.string())), ("outers", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for seq, (row, token, before, args, outers) in enumerate(calls_in(text)):
                    at.append(i)
                    found.append((row, seq, token, before, args, outers))
            if found:
                rest = b.select(keep).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(c, k[1]) for c, k in zip(zip(*found), kinds))], [*keep, *(k[0] for k in kinds)])

    return units.mapInArrow(run, f"{fields}, row int, seq int, token string, before string, args array<string>, outers array<string>")
