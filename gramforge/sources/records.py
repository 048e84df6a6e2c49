"""Delimited records with broken rows: an error-recovering recursive-descent reader.

Grammar (sep and quote are parameters):

    text    := record (eol record)*
    record  := field (sep field)*
    field   := bare | quoted
    bare    := any characters but sep, quote and eol
    quoted  := quote (character | quote quote)* quote      -- may hold sep and line breaks

A rule that fails raises a located error. Recovery: the reader resumes at the next
validated record-start anchor, i.e. the first later line start from which a whole record
parses with the right number of fields and a valid first field; the text before it is one faulty record. A record over
several lines that holds an anchor is taken for one whose quote was never closed.

Large files are read in chunks of whole lines. Anchors also tell where a chunk's first record starts: a chunk is parsed from its
first anchor on, and what lies between an open last record and the next chunk's first anchor is a seam, parsed by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.errors import InvalidOperation
from gramforge.util import checkpoint, col, free_name, join_on, require

#: The tokens that stand for a missing value.
NULL_TOKENS = ("", "NA", ".", "NaN", "NULL", "null")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_BLANKS = " \t\r\n\f\v"


@dataclass(frozen=True)
class FieldSpec:
    """kind: "double", "int" (a whole number in any notation), "flag" (exactly 0 or 1) or "string" (anything)."""

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False


class RecordError(Exception):
    def __init__(self, reason: str, at: int, field: int):
        super().__init__(reason)
        self.reason, self.at, self.field = reason, at, field


class Parser:
    """One reader per schema; `record` parses a record, `text` a whole text with recovery."""

    def __init__(self, specs: Sequence[FieldSpec], sep: str = ",", quote: str = '"'):
        if len(sep) != 1 or len(quote) != 1 or sep == quote:
            raise InvalidOperation("separator and quote must be two different characters")
        if bad := [s for s in specs if s.kind not in ("double", "int", "flag", "string")]:
            raise InvalidOperation(f"unknown field kinds: {bad}")
        s, q = re.escape(sep), re.escape(quote)
        self.specs, self.sep, self.quote = tuple(specs), sep, quote
        self._bare = re.compile(f"[^{s}{q}]*")
        self._bare_line = re.compile(f"[^{s}{q}\n]*")
        self._quoted = re.compile(f"{q}[^{q}]*(?:{q}{q}[^{q}]*)*{q}")

    def field(self, text: str, at: int, end: int, line: bool, k: int) -> tuple[str, int]:
        if at < end and text[at] == self.quote:
            m = self._quoted.match(text, at, end)
            if not m:
                raise RecordError("quoting", at, k)
            return text[at + 1 : m.end() - 1].replace(self.quote * 2, self.quote), m.end()
        stop = (self._bare_line if line else self._bare).match(text, at, end).end()
        return text[at:stop], stop

    def record(self, text: str, at: int = 0, end: int | None = None, line: bool = False) -> tuple[list[str], int, list[int]]:
        """Fields, where the record stops and where its fields start. line: a bare line break ends the record."""
        end = len(text) if end is None else end
        eol = text.find("\n", at, end) if line else -1
        eol = end if eol < 0 else eol
        if text.find(self.quote, at, eol) < 0:
            # Without a quote the grammar is a split.
            fields = text[at:eol].split(self.sep)
            starts = [at]
            for f in fields[:-1]:
                starts.append(starts[-1] + len(f) + 1)
            return fields, eol, starts
        fields, starts = [], []
        while True:
            starts.append(at)
            v, stop = self.field(text, at, end, line, len(fields))
            fields.append(v)
            if stop == end or line and (text[stop] == "\n" or text.startswith("\r\n", stop)):
                return fields, stop, starts
            if text[stop] != self.sep:
                raise RecordError("quoting", stop, len(fields) - 1)
            at = stop + 1

    def typed(self, fields: list[str], starts: list[int], stop: int) -> list:
        """Values of a record's fields, or RecordError with the first reason that applies, at the faulty or first surplus field or where a field is missing."""
        want = len(self.specs)
        if len(fields) != want:
            raise RecordError("column_count", starts[want] if len(fields) > want else stop, len(fields))
        out = []
        for k, (s, f) in enumerate(zip(self.specs, fields, strict=True)):
            try:
                out.append(self.value(s, f, k))
            except RecordError as e:
                e.at = starts[k]
                raise
        return out

    def value(self, spec: FieldSpec, raw: str, k: int):
        if spec.kind == "string":
            return raw
        v = raw.strip(_BLANKS)
        if v in NULL_TOKENS:
            return None
        if spec.kind == "flag":
            if v not in ("0", "1"):
                raise RecordError("invalid_value", 0, k)
            return int(v)
        if not _NUMBER.match(v):
            raise RecordError("invalid_value", 0, k)
        d: float | Decimal = float(v) if len(v) <= 15 and "e" not in v and "E" not in v else Decimal(v)
        if spec.low is not None and (d < spec.low or spec.low_open and d == spec.low) or spec.high is not None and d > spec.high:
            raise RecordError("invalid_value", 0, k)
        if spec.kind == "double":
            return float(d)
        if isinstance(d, Decimal) and d.adjusted() > 18 or d != (i := int(d)):
            raise RecordError("invalid_value", 0, k)
        return i

    def line(self, raw: str | None) -> tuple[list | None, str | None, int, int]:
        """Typed values, or None with reason, character offset and number of the faulty field."""
        raw = raw or ""
        if raw.endswith("\r"):
            raw = raw[:-1]
        try:
            fields, stop, starts = self.record(raw)
            return self.typed(fields, starts, stop), None, -1, -1
        except RecordError as e:
            return None, e.reason, e.at, e.field

    def text(self, text: str, *, at: int = 0, partial: bool = False, convert: bool = True) -> Iterator[tuple[int, int, list | None, RecordError | None]]:
        """(start, end, values, error) of every record from `at` on, resuming at anchors after broken quotes.

        partial: the text may go on; a last record that fails and has no anchor behind it is not given. convert: without it only borders are sought.
        """
        n = len(text)
        while at < n:
            if not convert:
                # Lines before the next quote are records, whatever they hold.
                q = text.find(self.quote, at)
                stop = text.rfind("\n", at, n if q < 0 else q)
                if stop >= 0 or q < 0:
                    stop = n if stop < 0 else stop
                    yield at, stop, None, None
                    at = stop + 1
                    continue
            values, error = None, None
            try:
                fields, stop, starts = self.record(text, at, n, True)
                if text.find("\n", at, stop) >= 0 and (a := self.anchor(text, at, stop)) is not None:
                    stop, error = a - 1, RecordError("quoting", at, 0)
                elif convert:
                    try:
                        values = self.typed(fields, starts, stop)
                    except RecordError as e:
                        error = e
            except RecordError as e:
                a = self.anchor(text, at, n)
                if a is None and partial:
                    return
                stop, error = n - text.endswith("\n") if a is None else a - 1, e
            yield at, stop, values, error
            at = stop + (2 if text.startswith("\r\n", stop) else 1)

    def is_anchor(self, text: str, at: int) -> bool:
        try:
            fields = self.record(text, at, len(text), True)[0]
            if len(fields) == len(self.specs):
                self.value(self.specs[0], fields[0], 0)
                return True
        except RecordError:
            pass
        return False

    def anchor(self, text: str, at: int, end: int) -> int | None:
        """The first line start after `at` and before `end` from which a record parses with all fields and a valid first one."""
        while (at := text.find("\n", at, end) + 1) > 0:
            if self.is_anchor(text, at):
                return at
        return None

    def start(self, text: str, first: bool) -> int | None:
        """Where the first record of a chunk starts; None if no line of it is an anchor."""
        return 0 if first or self.is_anchor(text, 0) else self.anchor(text, 0, len(text))


def _arrow(spec: FieldSpec) -> pa.DataType:
    return {"double": pa.float64(), "int": pa.int64(), "flag": pa.int64(), "string": pa.string()}[spec.kind]


def _spark(spec: FieldSpec) -> T.DataType:
    return {"double": T.DoubleType(), "int": T.LongType(), "flag": T.LongType(), "string": T.StringType()}[spec.kind]


def parse_lines(df: DataFrame, raw: str, specs: Sequence[FieldSpec], *, sep: str = ",", quote: str = '"') -> DataFrame:
    """Parse the column `raw`, one record per row; all rows come out, none is shuffled.

    Result: the columns of `df`, the typed fields (NULL in faulty rows), `reason` (NULL in valid rows,
    else quoting, column_count or invalid_value, the first that applies), `error_at` (character offset
    of the place where the grammar failed, of the faulty field or the first surplus one, or of the end where fields are missing) and `error_field` (number of the faulty field from 0, or the
    number of fields for column_count). One carriage return at the end is not part of a record. A NULL or empty
    record has one empty field. A made column whose name is taken gets underscores appended.
    Records of any length are read whole; an empty table gives an empty one.
    """
    require(df, raw)
    taken = list(df.columns)
    names = []
    for base in [*[s.name for s in specs], "reason", "error_at", "error_field"]:
        names.append(free_name(base, taken))
        taken.append(names[-1])
    kinds = [*[_spark(s) for s in specs], T.StringType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    types = [*[_arrow(s) for s in specs], pa.string(), pa.int32(), pa.int32()]
    specs = tuple(specs)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(specs, sep, quote)
        none = [None] * len(specs)
        for b in batches:
            rows = []
            for line in b.column(b.schema.names.index(raw)).to_pylist():
                values, reason, at, field = parser.line(line)
                rows.append((*(none if values is None else values), reason, None if reason is None else at, None if reason is None else field))
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])

    return df.mapInArrow(kernel, schema)


def read_records(spark: SparkSession, path: str, specs: Sequence[FieldSpec], *, sep: str = ",", quote: str = '"', header: bool = True, chunk_chars: int = 4_000_000) -> DataFrame:
    """Read delimited files of any size with recovery: see `parse_chunks` for the result; chunk_no tells where in the file a chunk lies.

    The lines of every file split are cut into chunks of about chunk_chars characters.
    header: a first record of a file that does not parse as a record of the data is its header, one whose first field is the first
    name of `specs`; a faulty first record of another kind comes out like any other.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size, key, piece = 0, None, 0

        def chunk() -> pa.RecordBatch:
            # A split has fewer than 2**20 chunks, as it has fewer bytes than 2**20 chunks have characters.
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([(key[1] << 20) + piece]), pa.array(["\n".join(held) + "\n"])], names=["file_name", "chunk_no", "text"])

        for batch in batches:
            for f, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((f, b) != key or size > chunk_chars):
                    yield chunk()
                    held, size, piece = [], 0, piece + 1 if (f, b) == key else 0
                key = (f, b)
                held.append(v)
                size += len(v) + 1
        if held:
            yield chunk()

    chunks = lines.mapInArrow(kernel, "file_name string, chunk_no long, text string")
    return parse_chunks(chunks, specs, file="file_name", chunk="chunk_no", text="text", sep=sep, quote=quote, header=header)


def parse_chunks(df: DataFrame, specs: Sequence[FieldSpec], *, file: str, chunk: str, text: str, sep: str = ",", quote: str = '"', header: bool = False) -> DataFrame:
    """The records of files given as chunks of whole lines: (file, chunk, start_at, typed fields..., reason, error_at, error_field, raw_record).

    chunk: integral, ascending in a file, 0 for its first chunk. start_at and error_at: characters from the
    start of that chunk (of the chunk in which the seam starts, for a record that spans chunks). Valid records have a NULL
    reason, error and raw_record; raw_record of a faulty one is its whole text without the line break at its end. An empty line is a record with one field, a trailing line break starts none. NULL and
    empty chunks hold no records. Fields may not be named like another result column.

    Every chunk is parsed by one task, twice: for its records and for the open ends at its borders, which alone are
    shuffled. A line inside a quoted field that looks like a whole record is taken for one if a chunk starts in that field.
    """
    require(df, file, chunk, text)
    specs = tuple(specs)
    made = ["start_at", "reason", "error_at", "error_field", "raw_record"]
    if len({n.lower() for n in [file, chunk, *made, *[x.name for x in specs]]}) < 7 + len(specs):
        raise InvalidOperation("fields, file and chunk need names of their own")
    src = df.where(F.length(col(text)) > 0).select(col(file).alias("f"), col(chunk).cast("long").alias("c"), col(text).alias("t"))
    kind = T.StructType([src.schema["f"], T.StructField("c", T.LongType()), T.StructField("start_at", T.LongType()), *[T.StructField(f"v{i}", _spark(x)) for i, x in enumerate(specs)], T.StructField("reason", T.StringType()), T.StructField("error_at", T.LongType()), T.StructField("error_field", T.IntegerType()), T.StructField("raw_record", T.StringType())])
    types = [pa.int64(), *[_arrow(x) for x in specs], pa.string(), pa.int64(), pa.int32(), pa.string()]
    none = [None] * len(specs)

    def rows(parser: Parser, text: str, at: int, first: bool, partial: bool, base: int) -> Iterator[tuple]:
        for start, stop, values, error in parser.text(text, at=at, partial=partial):
            if error is None:
                yield (base + start, *values, None, None, None, None)
            else:
                raw = text[start:stop]
                raw = raw[:-1] if raw.endswith("\r") else raw
                if not (header and first and start == 0 and raw.partition(sep)[0].strip(_BLANKS + quote).lower() == specs[0].name.lower()):
                    yield (base + start, *none, error.reason, base + error.at, error.field, raw)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(specs, sep, quote)
        for b in batches:
            for i, (c, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (at := parser.start(t, c == 0)) is not None:
                    yield from _packed(b, i, rows(parser, t, at, c == 0, True, 0))

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(specs, sep, quote)
        for b in batches:
            for i, (c, t, base) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                yield from _packed(b, i, rows(parser, t, 0, c == 0 and base == 0, False, base))

    def _packed(b: pa.RecordBatch, i: int, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(found, 20_000)):
            own = pa.array([i] * len(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *[pa.array(x, t) for x, t in zip(zip(*part, strict=True), types, strict=True)]], names=kind.names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk: whether it has an anchor, the text before its first one, the text of its open last record and where that starts."""
        parser = Parser(specs, sep, quote)
        for b in batches:
            out = []
            for c, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = parser.start(t, c == 0)
                if at is None:
                    out.append((False, t, "", 0))
                    continue
                done = at
                for _, stop, _, _ in parser.text(t, at=at, partial=True, convert=False):
                    done = stop + (2 if t.startswith("\r\n", stop) else 1)
                out.append((True, t[:at], t[done:], done))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip(cols, (pa.bool_(), pa.string(), pa.string(), pa.int64()), strict=True)]], names=["f", "c", "anchored", "head", "tail", "done"])

    open_ = T.StructType([src.schema["f"], T.StructField("c", T.LongType()), *T.StructType.fromDDL("anchored boolean, head string, tail string, done long").fields])
    edge = checkpoint(src.mapInArrow(ends, open_))
    # The chunk whose open record a chunk's head goes on with; only numbers and flags enter the window.
    w = Window.partitionBy("f").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    owner = edge.select("f", "c", F.last(F.when(F.col("anchored"), F.col("c")), True).over(w).alias("own"))
    heads = join_on(edge.where("head <> ''").select("f", "c", "head"), owner, ["f", "c"], "inner").select("f", F.col("own").alias("o"), "c", F.col("head").alias("x"), F.lit(0).cast("long").alias("done"))
    tails = edge.where("anchored").select("f", F.col("c").alias("o"), "c", F.col("tail").alias("x"), "done")
    parts = tails.unionByName(heads).groupBy("f", "o").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("p"), F.max("done").alias("done"))
    seam = parts.select("f", F.col("o").alias("c"), F.array_join(F.col("p.x"), "").alias("t"), "done").where("t <> ''")
    out = src.mapInArrow(records, kind).unionByName(seam.mapInArrow(seams, kind))
    return out.select(F.col("f").alias(file), F.col("c").alias(chunk), "start_at", *[F.col(f"v{i}").alias(x.name) for i, x in enumerate(specs)], "reason", "error_at", "error_field", "raw_record")
