"""WARC archives: writing pages as records with revisits, and reading them back by boundary-chain verification.

The writer makes gzip streams of records by Spark's text writer, with the record terminator as line separator. The
reader takes the lines of each split; wherever a record header could begin it emits a candidate with the offset of the
record and of its successor, magic inside payloads included. Per file, over all its splits, pointer jumping from offset
0 then keeps the candidates that the chain of successors reaches; all others were payload. A header or payload that the
end of a split cuts in two is put together from the splits that hold its parts.

Defined results: null html is an empty payload; a null ``page_id`` is written as such and read back as null, and is
never what others refer to; rows that repeat a ``page_id`` are records of their own. Of equal payloads those with the
largest ``page_id`` are responses. Other columns are ignored; line breaks and blanks in a URL become ``%20``. Payloads of
any length are written and read whole; a table or folder without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceaudit.llm.store import materialise

BLANK_LINE = "\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 1000
#: Parts of a group of equal payloads, so a payload of a third of all pages is so many keys.
SALTS = 16
_DATE = "2000-01-01T00:00:00Z"
#: A longer header is none.
HEADER_BYTES = 16 << 10
_PIECE_BYTES = 64 << 10
_HEADER, _MAGIC, _HEAD_END = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"(?m)^WARC/1\.[01]\r\n"), b"\r\n\r\n"


# Writing


def record_kinds(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload`` with ``origin``: the page that holds an equal payload, or null."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("_key", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least_bytes
    equal = (
        rows.filter(long).groupBy("_key").agg(F.max("page_id").alias("origin"), F.count("*").alias("_n"))
        .filter("_n > 1 and origin is not null")
        .select(F.col("_key").alias("_k"), "origin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    )
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("_part", part).join(equal, (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_s")), "left")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("origin")), F.col("origin"))
    return joined.select("page_id", "url", "payload", other.alias("origin"))


def _header_lines(*pairs: tuple[str, Column]) -> list[Column]:
    return [x for name, value in pairs for x in (F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))]


def record_text(page_id: Column, url: Column, payload: Column, origin: Column) -> Column:
    """A whole record but for the blank line that ends it."""
    urn = lambda value: F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))
    size = F.octet_length(payload)
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(origin.isNull(), "response").otherwise("revisit"),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\n"),
        *_header_lines(
            ("WARC-Record-ID", urn(page_id)), ("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"\s", "%20")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload))), ("X-Payload-Length", size),
        ),
    ]
    full = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\n"), *_header_lines(("Content-Length", size)), F.lit("\r\n"), payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    revisit = F.concat(F.lit(f"WARC-Profile: {profile}\r\n"), *_header_lines(("WARC-Refers-To", urn(origin))), F.lit("Content-Length: 0\r\n\r\n"))
    return F.concat(*head, F.when(origin.isNull(), full).otherwise(revisit))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES, compression: str = "gzip") -> None:
    rows = record_kinds(pages, least_bytes)
    text = record_text(*[F.col(c) for c in ("page_id", "url", "payload", "origin")])
    rows.select(text.alias("value")).write.option("lineSep", BLANK_LINE).option("compression", compression).text(folder)


# Reading

#: Kinds of rows that a split is read into: possible records, headers that its end cuts, and the split itself.
CANDIDATE, PART, SPLIT = range(3)
_FIELDS = "record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, told string"
_FOUND = f"file string, block bigint, kind int, start bigint, body bigint, length bigint, {_FIELDS}, digest string, raw binary"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    pairs = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else ((),) * len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, pairs)], [n for n, _ in pairs])


def _fields(head: bytes) -> dict[bytes, bytes] | None:
    if not _HEADER.match(head):
        return None
    pairs = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
    return fields if fields.get(b"content-length", b"").isdigit() else None


def _told(fields: dict[bytes, bytes]) -> tuple:
    """What a header says, in the columns ``_FIELDS``."""
    text = lambda name: fields.get(name, b"").decode("utf-8", "replace")
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text(name))) else None
    revisit, size = text(b"warc-type") == "revisit", text(b"x-payload-length")
    length = (int(size) if size.isdigit() else None) if revisit else int(fields[b"content-length"])
    told = text(b"warc-payload-digest").removeprefix("sha1:")
    return text(b"warc-type"), page(b"warc-record-id"), text(b"warc-target-uri"), page(b"warc-refers-to") if revisit else None, length, told


class _Candidate:
    """A possible record whose block is being read."""

    def __init__(self, start: int, body: int, fields: dict[bytes, bytes], keep: bool) -> None:
        self.start, self.body, self.length, self.told = start, body, int(fields[b"content-length"]), _told(fields)
        self.missing, self.digest = self.length, hashlib.sha1()
        self.parts: list[bytes] | None = [] if keep else None

    def feed(self, raw: memoryview) -> None:
        part = raw[: self.missing]
        self.digest.update(part)
        self.missing -= len(part)
        if self.parts is not None:
            self.parts.append(bytes(part))

    def row(self, where: tuple) -> tuple:
        """As found; without digest where the split ends first."""
        whole = not self.missing
        payload = b"".join(self.parts) if self.parts is not None and whole else None
        return (*where, CANDIDATE, self.start, self.body, self.length, *self.told, self.digest.hexdigest() if whole else None, payload)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """File and split of runs of lines, and their bytes."""
    for batch in batches:
        ids = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        lines = batch.column("value").cast(pa.binary()).to_pylist()
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            yield ids[a], b"\n".join([*lines[a:b], b""])


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(folder)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def scan(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of the three kinds; ``start`` and ``body`` count from the first line of the split.

    A split holds the lines that begin in it. A header is a line ``WARC/1.x`` and those after it up to an empty one, so
    every true record begins at such a line, and so may what looks like one in a payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, lead = None, 0, b""
        open_: list[_Candidate] = []
        pending: list[tuple[int, bytes]] = []  # headers without their end so far
        rows: list[tuple] = []

        def close() -> None:
            rows.extend(record.row(here) for record in open_)
            rows.extend((*here, PART, start, None, None, *[None] * 6, None, head) for start, head in pending)
            rows.append((*here, SPLIT, 0, None, at, *[None] * 6, None, lead))

        for where, raw in _blocks(batches):
            if where != here:
                if here is not None:
                    close()
                here, at, lead, open_, pending = where, 0, b"", [], []
            if len(lead) < HEADER_BYTES:
                lead += raw[: HEADER_BYTES - len(lead)]
            view = memoryview(raw)
            for record in open_:
                record.feed(view)
            heads = [(start, head + raw[: HEADER_BYTES - len(head)], at - len(head)) for start, head in pending]
            heads += [(at + m.start(), raw[m.start() : m.start() + HEADER_BYTES], at + m.start()) for m in _MAGIC.finditer(raw)]
            pending = []
            for start, head, offset in heads:
                end = head.find(_HEAD_END)
                if end < 0:
                    if len(head) < HEADER_BYTES:
                        pending.append((start, head))
                elif (fields := _fields(head[:end])) is not None:
                    record = _Candidate(start, offset + end + len(_HEAD_END), fields, with_payload)
                    record.feed(view[max(0, record.body - at) :])
                    open_.append(record)
            rows.extend(record.row(here) for record in open_ if not record.missing)
            open_ = [record for record in open_ if record.missing]
            at += len(raw)
            if rows:
                yield _batch(rows, _FOUND)
                rows.clear()
        if here is not None:
            close()
        yield _batch(rows, _FOUND)

    return _lines(spark, folder).mapInArrow(read, _FOUND)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every possible record whose header a split holds."""
    return scan(spark, folder).filter(F.col("kind") == CANDIDATE)


def reached(start: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Which candidates the chain of successors reaches from offset 0, by pointer jumping."""
    order = np.argsort(start)
    sorted_start = np.append(start[order], -1)
    count = len(order)
    jump = np.minimum(np.searchsorted(sorted_start[:count], next_[order]), count)
    jump[sorted_start[jump] != next_[order]] = count  # no record begins there
    jump = np.append(jump, count)
    seen = np.zeros(count + 1, dtype=bool)
    seen[:1] = count > 0 and sorted_start[0] == 0
    while True:
        now = seen.copy()
        now[jump[seen]] = True
        jump = jump[jump]
        if (now == seen).all() or (jump == count).all():
            now[jump[now]] = True
            break
        seen = now
    out = np.zeros(count, dtype=bool)
    out[order] = now[:count]
    return out


_CHAINED = f"file string, start bigint, next bigint, head boolean, {_FIELDS}, block bigint, low bigint, high bigint"


def _chain(table: pa.Table) -> pa.Table:
    """True records of a file: a row each, and for those that a split's end cuts a row for each split that holds a piece.

    Offsets count from the start of the file, ``low`` and ``high`` from that of the split.
    """
    rows = table.to_pylist()
    file = rows[0]["file"]
    splits = sorted((r["base"], r["block"], r["length"], r["raw"]) for r in rows if r["kind"] == SPLIT)
    bases = [x[0] for x in splits]
    records = [(r["start"], r["body"], r["length"], r["open"], None) for r in rows if r["kind"] == CANDIDATE]
    for r in rows:
        if r["kind"] == PART:  # the rest of the header begins the splits that follow
            head = r["raw"]
            for base, _, size, lead in splits[bisect_right(bases, r["start"]) :]:
                if _HEAD_END in head or len(head) >= HEADER_BYTES:
                    break
                head += lead
                if size > len(lead):
                    break
            end = head.find(_HEAD_END)
            fields = _fields(head[:end]) if 0 <= end else None
            if fields is not None:
                records.append((r["start"], r["start"] + end + len(_HEAD_END), int(fields[b"content-length"]), True, _told(fields)))
    true = reached(np.array([r[0] for r in records], dtype=np.int64), np.array([r[1] + r[2] + len(BLANK_LINE) for r in records], dtype=np.int64))
    out = []
    for (start, body, length, open_, told), ok in zip(records, true):
        if not ok:
            continue
        row = (file, start, body + length + len(BLANK_LINE), told is not None, *(told or [None] * 6))
        out.append((*row, None, None, None))
        if open_:
            for base, block, size, _ in splits[max(0, bisect_right(bases, body) - 1) :]:
                if base >= body + max(length, 1):
                    break
                out.append((*row, block, max(0, body - base), min(size, body + length - base)))
    return pa.Table.from_batches([_batch(out, _CHAINED)])


def _pieces(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``file, start, payload`` of records that splits cut: ``wanted`` says which bytes of which split are theirs."""
    schema = "file string, block bigint, at bigint, raw binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for where, raw in _blocks(batches):
            at = at if where == here else 0
            here = where
            yield _batch([(*where, at + k, raw[k : k + _PIECE_BYTES]) for k in range(0, len(raw), _PIECE_BYTES)], schema)
            at += len(raw)

    def join(table: pa.Table) -> pa.Table:
        order = table.sort_by([("block", "ascending"), ("at", "ascending")])
        return pa.table({"file": order.column("file")[:1], "start": order.column("start")[:1], "payload": [b"".join(order.column("raw").to_pylist())]})

    # Only files that Spark splits hold such records; the pieces that no record wants go before anything is shuffled.
    files = wanted.select("file").distinct()
    parts = _lines(spark, folder).join(files, "file", "left_semi").mapInArrow(cut, schema).join(wanted, ["file", "block"])
    own = parts.filter((F.col("at") < F.col("high")) & (F.col("at") + F.octet_length("raw") > F.col("low")))
    first = F.greatest(F.col("low") - F.col("at"), F.lit(0))
    raw = F.substr("raw", (first + 1).cast("int"), (F.least(F.col("high") - F.col("at"), F.octet_length("raw")) - first).cast("int"))
    return own.select("file", "start", "block", "at", raw.alias("raw")).groupBy("file", "start").applyInArrow(join, "file string, start bigint, payload binary")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives in a folder; with their payloads, if wanted.

    Files may be compressed, which Spark reads as one split, or not, and then have many: sums over the earlier splits of a
    file tell where in it a split begins, and the chain goes through all of them.
    """
    found = materialise(scan(spark, folder))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.filter(F.col("kind") == SPLIT).select("file", "block", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("base"))
    placed = found.join(bases, ["file", "block"]).withColumns({"start": F.col("start") + F.col("base"), "body": F.col("body") + F.col("base")})
    narrow = placed.select("file", "block", "base", "kind", "start", "body", "length", F.col("digest").isNull().alias("open"), "raw")
    chained = materialise(narrow.groupBy("file").applyInArrow(_chain, _CHAINED))
    records = chained.filter("block is null")
    told = [c.split()[0] for c in _FIELDS.split(", ")]
    known = placed.filter(F.col("kind") == CANDIDATE).select("file", "start", *told, "digest")
    # Merge joins at every size: records grow with the archives.
    whole = records.filter("not head").select("file", "start", "next").join(known.hint("merge"), ["file", "start"]).unionByName(
        records.filter("head").select("file", "start", "next", *told, F.lit(None).cast("string").alias("digest"))
    )
    cut = chained.filter("block is not null").select("file", "start", "block", "low", "high")
    payloads = None if cut.isEmpty() else materialise(_pieces(spark, folder, cut))
    if payloads is not None:
        sums = payloads.select("file", "start", F.sha1("payload").alias("_sum"))
        whole = whole.join(sums.hint("merge"), ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "_sum")).drop("_sum")
    revisit = F.col("record_type") == "revisit"
    out = whole.select(
        "file", "start", "next", "record_type", "page_id", "url", "refers_to", "payload_bytes",
        F.when(revisit, F.col("told")).otherwise(F.col("digest")).alias("payload_digest"),
        (revisit | F.coalesce(F.col("digest") == F.col("told"), F.lit(False))).alias("verified"),
    )
    if not with_payload:
        return out
    bodies = scan(spark, folder, True).filter((F.col("kind") == CANDIDATE) & F.col("raw").isNotNull())
    held = bodies.join(bases, ["file", "block"]).select("file", (F.col("start") + F.col("base")).alias("start"), F.col("raw").alias("payload"))
    return out.join((held if payloads is None else held.unionByName(payloads)).hint("merge"), ["file", "start"])
