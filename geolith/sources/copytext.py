"""The text form of bulk copies: tab-separated fields, a line for each row.

`\\N` alone is null and an empty field an empty string; `\\.` alone on a line ends the
data; escapes are undone after fields are told apart. Every error has a SQLSTATE and
tells the row. `decode` works on bytes that come in pieces cut anywhere.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from decimal import Context, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geolith.errors import EngineError
from geolith.operators.layout import spatial_kind

MAX_ROW_BYTES = 1 << 20
BATCH_ROWS = 65_536
BATCH_BYTES = 8 << 20
_ESCAPES = {ord("b"): 8, ord("f"): 12, ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("v"): 11}
_SPECIAL = re.compile(rb"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|[\s\S]|$)")
_EXACT = Context(prec=60)
_TRUE, _FALSE = {"t", "true", "1", "y", "yes", "on"}, {"f", "false", "0", "n", "no", "off"}
_INT_BITS = {T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _undo(found: re.Match) -> bytes:
    x = found[1]
    if not x:
        raise EngineError("22P04", "a field ends in a lone backslash")
    if x[:1] == b"x" and len(x) > 1:
        return bytes([int(x[1:], 16)])
    if x[0] in b"01234567":
        return bytes([int(x, 8) & 0xFF])
    return bytes([_ESCAPES.get(x[0], x[0])])


def unescape(field: bytes) -> bytes | None:
    """A field's bytes; None for a null."""
    if field == b"\\N":
        return None
    return _SPECIAL.sub(_undo, field) if b"\\" in field else field


def _binary(text: str, geometry: bool) -> bytes:
    body = text[2:] if text.startswith("\\x") else text if geometry else None
    if body is None or len(body) % 2 or not re.fullmatch(r"[0-9A-Fa-f]*", body):
        raise EngineError("22P02", "bytes must be written \\x and hexadecimal")
    return bytes.fromhex(body)


def _decimal(text: str, kind: T.DecimalType) -> Decimal:
    if not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)", text):
        raise EngineError("22P02", f"{text!r} is no decimal")
    value = Decimal(text)
    if len(value.as_tuple().digits) > 29:
        raise EngineError("22P02", "a decimal has too many digits")
    whole, _, part = text.lstrip("+-").partition(".")
    if part[kind.scale :].strip("0"):
        raise EngineError("22003", "a decimal has more places than its column")
    if len(whole.lstrip("0")) > kind.precision - kind.scale:
        raise EngineError("22003", "a decimal has more digits than its column")
    return value.quantize(Decimal(1).scaleb(-kind.scale), context=_EXACT)


def value(raw: bytes | None, field: T.StructField):
    """A field's value in its column's type."""
    if raw is None:
        return None
    kind = field.dataType
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        raise EngineError("22021", "a field isn't UTF-8") from e
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return _binary(text, spatial_kind(field.name, kind) is not None)
    if isinstance(kind, T.BooleanType):
        if text.lower() in _TRUE | _FALSE:
            return text.lower() in _TRUE
        raise EngineError("22P02", f"{text!r} is no boolean")
    if type(kind) in _INT_BITS:
        limit = 1 << _INT_BITS[type(kind)] - 1
        if not re.fullmatch(r"[-+]?[0-9]+", text) or not -limit <= int(text) < limit:
            raise EngineError("22P02", f"{text!r} is no integer of this column")
        return int(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        try:
            if "_" in text or text != text.strip():
                raise ValueError
            return float(text)
        except ValueError as e:
            raise EngineError("22P02", f"{text!r} is no number") from e
    if isinstance(kind, T.DecimalType):
        return _decimal(text, kind)
    try:
        if isinstance(kind, T.DateType):
            return dt.datetime.strptime(text, "%Y-%m-%d").date()
        if isinstance(kind, T.TimestampNTZType):
            return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f" if "." in text else "%Y-%m-%d %H:%M:%S")
    except ValueError as e:
        raise EngineError("22007", f"{text!r} is no date or time") from e
    raise EngineError("0A000", f"no copies into {kind.simpleString()}")


def lines(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Rows' bytes up to the end mark; anything behind it is an error."""
    rest, ended = b"", False
    for chunk in chunks:
        rest += chunk
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if ended:
                raise EngineError("22P04", "data goes on behind its end mark")
            line = line.removesuffix(b"\r")
            if line == b"\\.":
                ended = True
                continue
            if len(line) > MAX_ROW_BYTES:
                raise EngineError("54000", "a row is too long")
            yield line
        if ended and rest:
            raise EngineError("22P04", "data goes on behind its end mark")
        if len(rest) > MAX_ROW_BYTES:
            raise EngineError("54000", "a row is too long")
    if rest and not ended and rest.removesuffix(b"\r") != b"\\.":
        yield rest.removesuffix(b"\r")


def decode(chunks: Iterable[bytes], schema: T.StructType) -> Iterator[tuple]:
    """Rows of a schema's types."""
    for number, line in enumerate(lines(chunks), 1):
        fields = line.split(b"\t")
        if len(fields) != len(schema):
            raise EngineError("22P04", f"row {number} has {len(fields)} columns instead of {len(schema)}")
        try:
            yield tuple(value(unescape(f), s) for f, s in zip(fields, schema, strict=True))
        except EngineError as e:
            raise EngineError(e.sqlstate, f"row {number}: {e.message}") from e


def batches(rows: Iterable[tuple], size=lambda r: sum(len(v) if isinstance(v, (str, bytes)) else 8 for v in r)) -> Iterator[list[tuple]]:
    """Rows in lists within BATCH_ROWS and BATCH_BYTES, so that memory stays bounded."""
    held, held_bytes = [], 0
    for row in rows:
        n = size(row)
        if n > BATCH_BYTES:
            raise EngineError("54000", "a row is too large for a batch")
        if held and (len(held) >= BATCH_ROWS or held_bytes + n > BATCH_BYTES):
            yield held
            held, held_bytes = [], 0
        held.append(row)
        held_bytes += n
    if held:
        yield held


def read_copy(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of copy text files, decoded where the files are read.

    Each file is a copy of its own; an error anywhere fails the whole read.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for content in batch.column(0).to_pylist():
                for rows in batches(decode([content], schema)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def encode(rows: Iterable[tuple]) -> bytes:
    """Rows as copy text."""

    def field(v) -> bytes:
        if v is None:
            return b"\\N"
        text = ("t" if v else "f") if isinstance(v, bool) else "\\x" + v.hex() if isinstance(v, (bytes, bytearray)) else str(v)
        out = text.encode().replace(b"\\", b"\\\\")
        for sign, letter in ((b"\t", b"\\t"), (b"\n", b"\\n"), (b"\r", b"\\r")):
            out = out.replace(sign, letter)
        return out

    return b"".join(b"\t".join(map(field, r)) + b"\n" for r in rows)
