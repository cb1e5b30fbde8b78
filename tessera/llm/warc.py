"""WARC records, and not-modified revisits resolved against earlier captures.

A revisit of the server-not-modified profile repeats no body. It is resolved by an as-of join: the
latest full response of the same canonical URL with an earlier date. Its validators are
checked (entity tags by weak comparison, else dates of modification), and the stored headers
are updated by those that a 304 may carry. The join runs on DataFrame functions alone and in two levels: the
latest response within a stretch of time, and the one carried over from the stretches before, so
that a URL with a third of all captures is dealt out by time.

Defined cases of resolve(): a revisit without URL or date, or without an earlier response, has outcome
`no_original`; one whose validators differ is `mismatch` and gets no body; without validators in common it is
`unchecked` and gets the body; else `resolved`. Of responses of equal date the larger record_id
counts, of responses of one record_id one. Repeated revisits come back one by one. Names of headers are lower case.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship
from tessera.llm.sstable import open_store

URL_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# fixed values: header fields that a 304 response updates (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
STRETCH = 7 * 86_400_000_000  # microseconds
RECORD = "record_id string, warc_type string, uri string, date string, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port or fragment, a path, parameters in order."""
    part = [F.regexp_extract(url, URL_PARTS, k) for k in range(5)]
    scheme, host = F.lower(part[1]), F.lower(part[2])
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part[3] == "", "/").otherwise(part[3])
    query = F.array_join(F.array_sort(F.filter(F.split(part[4], "&"), lambda x: x != "")), "&")
    built = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part[1] == "", F.trim(url)).otherwise(built)


def resolve(records: DataFrame, stretch: int = STRETCH, bodies: DataFrame | None = None) -> DataFrame:
    """(record_id, url, original_id, outcome, headers, body) of every revisit; records: columns of RECORD.

    bodies: (record_id, body) of full responses, if records come without them.
    """
    with_body = F.col("body") if bodies is None else F.lit(None).cast("binary").alias("body")
    timed = records.select("record_id", "warc_type", "headers", "status", with_body, canonical(F.col("uri")).alias("url"), F.unix_micros(F.try_to_timestamp("date")).alias("t"))
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("t").isNotNull(), F.lit(False))
    own = F.when(F.col("warc_type") == "revisit", F.col("headers"))
    slim = timed.where(full | (F.col("warc_type") == "revisit")).select("record_id", "url", "t", full.alias("full"), own.alias("headers"), F.floor(F.col("t") / stretch).alias("stretch"))
    placed = slim.where("url is not null and t is not null")
    mark = F.when(F.col("full"), F.struct("t", "record_id"))
    within = Window.partitionBy("url", "stretch").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("near", F.max(mark).over(within)).where("not full")
    before = Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("url", "stretch").agg(F.max(mark).alias("last")).select("url", "stretch", F.max("last").over(before).alias("far"))
    found = inner.join(carried, ["url", "stretch"]).select("record_id", "url", "headers", F.coalesce("near", "far").getField("record_id").alias("original_id"))
    lost = slim.where("not full and (url is null or t is null)").select("record_id", "url", "headers", F.lit(None).cast("string").alias("original_id"))
    revisits = found.unionByName(lost)
    # bodies take part in one shuffle, by the identifier that they are joined on, and are never broadcast
    if bodies is None:
        stored = timed.where(full).groupBy(F.col("record_id").alias("original_id")).agg(F.min_by(F.struct(F.col("headers").alias("stored"), "body"), F.xxhash64("t", "body")).alias("r")).select("original_id", "r.*")
        both = revisits.join(stored.hint("merge"), "original_id", "left")
    else:
        stored = timed.where(full).groupBy(F.col("record_id").alias("original_id")).agg(F.min_by(F.col("headers"), F.xxhash64("t")).alias("stored"))
        held = bodies.groupBy(F.col("record_id").alias("original_id")).agg(F.min("body").alias("body"))
        both = revisits.join(stored, "original_id", "left").join(held.hint("merge"), "original_id", "left")

    def tag(h: str) -> Column:
        return F.regexp_replace(F.col(h)["etag"], "^W/", "")

    def modified(h: str) -> Column:
        return F.col(h)["last-modified"]

    same = F.coalesce(tag("headers") == tag("stored"), modified("headers") == modified("stored"))
    outcome = F.when(F.col("original_id").isNull(), "no_original").when(same, "resolved").when(~same, "mismatch").otherwise("unchecked")
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(updates), k), F.lit(False))), F.coalesce(updates, F.create_map().cast("map<string,string>")))
    usable = F.col("outcome").isin("resolved", "unchecked")
    return both.withColumn("outcome", outcome).select("record_id", "url", "original_id", "outcome", F.when(usable, merged).otherwise(F.col("headers")).alias("headers"), F.when(usable, F.col("body")).alias("body"))


def record_bytes(r: dict) -> bytes:
    """One record as a gzip member."""
    revisit = r["warc_type"] == "revisit"
    http = [f"HTTP/1.1 {r['status']} {'Not Modified' if revisit else 'OK'}", *(f"{k}: {v}" for k, v in sorted((r["headers"] or {}).items()))]
    block = "\r\n".join(http).encode() + b"\r\n\r\n" + (r["body"] or b"")
    head = ["WARC/1.1", f"WARC-Type: {r['warc_type']}", f"WARC-Record-ID: <{r['record_id']}>"]
    head += [f"{k}: {v}" for k, v in (("WARC-Target-URI", r["uri"]), ("WARC-Date", r["date"]), ("WARC-Profile", NOT_MODIFIED if revisit else None)) if v is not None]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return zlib.compress(b"".join(("\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n")), 1, 31)


def fields_of(raw: bytes) -> dict[str, str]:
    """Header fields with names in lower case; folded lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def inflated(stream, size: int = 1 << 20, step: int = 1 << 14) -> Iterator[bytes]:
    """Parts of a plain stream, or of one of gzip members.

    Members are fed `step` bytes at a time: what lies behind a member's end is copied, for every member.
    """
    held = stream.read(size)
    if held[:2] != b"\x1f\x8b":
        while held:
            yield held
            held = stream.read(size)
        return
    member = zlib.decompressobj(31)
    while held:
        out, view = [], memoryview(held)
        for at in range(0, len(held), step):
            out.append(member.decompress(view[at : at + step]))
            while member.eof and (rest := member.unused_data):
                member = zlib.decompressobj(31)
                out.append(member.decompress(rest))
            if member.eof:
                member = zlib.decompressobj(31)
        yield b"".join(out)
        held = stream.read(size)


def parse(stream, fields_too: bool = True) -> Iterator[dict]:
    """Response and revisit records of a plain or gzipped stream, one at a time; a record that is cut off is left out. Header fields of HTTP are left out unless asked for."""
    parts, held, at = inflated(stream), b"", 0

    def more() -> bool:
        nonlocal held, at
        if (part := next(parts, None)) is None:
            return False
        held, at = held[at:] + part, 0
        return True

    while True:
        while (start := held.find(b"WARC/", at)) < 0 or (end := held.find(b"\r\n\r\n", start)) < 0:
            if not more():
                return
        head = fields_of(held[start:end])
        at, size = start, int(head.get("content-length", 0))
        while len(held) < at + (end - start) + 4 + size:
            if not more():
                return
            end, start = end - start, 0
        begin = end + 4
        at = begin + size
        kind = head.get("warc-type")
        if kind in ("response", "revisit"):
            top, _, body = held[begin:at].partition(b"\r\n\r\n")
            line, _, fields = top.partition(b"\r\n")
            status = line.split()
            yield {"record_id": head.get("warc-record-id", "").strip("<>"), "warc_type": kind, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "headers": fields_of(fields) if fields_too else None, "body": body if kind == "response" else None}


ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])


def write(records: DataFrame, folder: str) -> DataFrame:
    """Plan that writes a gzipped file a partition to a shared folder; rows: name and number of records."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name, own, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", f"{root}/.{uuid.uuid4().hex}.tmp", 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    columns = (x.to_pylist() for x in batch.slice(at, 256).columns)
                    for row in zip(*columns):
                        r = dict(zip(ARROW.names, row))
                        out.write(record_bytes(r | {"headers": dict(r["headers"] or ())}))
                        n += 1
        store.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    return records.select(*ARROW.names).mapInArrow(run, "name string, records long")


def read(spark: SparkSession, names: DataFrame, folder: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Records of the named files of a folder, streamed; `only` some columns, and then with `body` only full responses."""
    ship(spark)
    columns = only or tuple(ARROW.names)
    schema = pa.schema([ARROW.field(c) for c in columns])
    bodies = bool(only) and "body" in only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    held: list[tuple] = []
                    for r in parse(raw, "headers" in columns):
                        if bodies and (r["warc_type"], r["status"]) != ("response", 200):
                            continue
                        held.append(tuple(list(r[c].items()) if c == "headers" else r[c] for c in columns))
                        if len(held) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    kinds = {f.split(" ")[0]: f for f in RECORD.split(", ")}
    return names.select("name").mapInArrow(run, ", ".join(kinds[c] for c in columns))


def captures(pages: DataFrame) -> DataFrame:
    """Records of three visits of every page: a full response, and two revisits with other spellings of its URL.

    The second visit has the right entity tag; the third has another one on every third page, and none on
    every fifth.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    tag = F.concat(F.lit('"'), F.md5(body), F.lit('"'))
    pages = pages.where("page_id is not null")

    def visit(k: int, kind: str, uri: Column, headers: Column, body: Column) -> DataFrame:
        date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + k * 864_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return pages.select(F.concat(F.lit(f"urn:capture:{k}:"), "page_id").alias("record_id"), F.lit(kind).alias("warc_type"), uri.alias("uri"), date.alias("date"), F.lit(200 if not k else 304).alias("status"), headers.alias("headers"), body.alias("body"))

    url = F.col("url")
    upper = F.regexp_replace(F.regexp_replace(url, "^https://", "HTTPS://"), "^http://", "HTTP://")
    first = visit(0, "response", url, F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.lit("first")), body)
    second = visit(1, "revisit", upper, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), F.lit("second"), F.lit("server"), F.lit("x")), F.lit(None).cast("binary"))
    other = F.when(F.col("page_id") % 3 == 0, F.lit('"other"')).otherwise(tag)
    third = visit(2, "revisit", F.concat(url, F.lit("#again")), F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("vary"), F.lit("accept"))).otherwise(F.create_map(F.lit("etag"), other, F.lit("vary"), F.lit("accept"))), F.lit(None).cast("binary"))
    return first.unionByName(second).unionByName(third)
