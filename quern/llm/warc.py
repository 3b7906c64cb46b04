"""Operator 3: WARC archives, written and read back by verified record boundaries.

Writing is JVM-side: a record is one line of Spark's text writer whose line separator
is the CR LF CR LF that ends a record. Of pages with equal payloads that with the
largest page_id is a response and the others revisit it.

Reading splits archives at every occurrence of the version line, in a payload or
not, and trusts none: each occurrence is a candidate record, whose Content-Length
gives the offset of its successor. Tasks resolve chains inside their block and emit
where they leave it; pointer jumping over these exits, from each file's start, finds
the block entries that are reachable, in as many rounds as the logarithm of a file's
blocks; walking each block from its entry retains the true records. Everything else
was part of a payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import durable, shared_dir, small

VERSION = "WARC/1.1"
MAGIC = VERSION + "\r\n"
#: Fixed values of the format.
ENDING = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:quern:page:"
#: Bytes of an archive in which parts of split payloads are looked up together.
CELL = 1 << 20


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, n, digest: nulls are empty, n is the html's bytes, digest its bare upper-case base32 SHA-1.

    The SHA-1 is a column of its own, computed once a row; each 10 of its hex digits are 8 of base 32.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), body.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    parts = [F.lpad(F.conv(F.substring("digest", k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return rows.withColumn("digest", F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def records(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the records of page_id, url and html, without their ending.

    A null html is the empty payload. Payloads of fewer than ``least`` bytes are always
    responses. Rows that tie for the largest page_id of a payload are all responses; a
    null page_id is smaller than any. Only (digest, page_id) is shuffled to find revisits.
    """
    rows = hashed(pages)
    found = rows.select("page_id", "digest", "n")
    last = found.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("rows"))
    # Copies only: where all payloads differ nothing is joined at all.
    repeated = small(durable(last.where("rows > 1").select("digest", "last")))
    full = rows.join(repeated, "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.col("n") >= least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(ENDING))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20\\x7F]+", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("last")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(ENDING),
    )
    return full.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    records(pages, least).write.option("lineSep", ENDING).text(path)


def _parsed(chunk: bytes) -> dict | None:
    """Header fields of what follows a version line, or None if it isn't a record's head."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in chunk[:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower()] = v.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    fields["head"], fields["length"] = end + 4, int(length)
    return fields


def _payload(fields: dict, block: bytes) -> tuple[int, str]:
    """(bytes, digest) of a record's payload; a revisit's are those that it states."""
    head, _, body = block.partition(b"\r\n\r\n")
    if fields[b"warc-type"] == b"revisit":
        stated = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return int((stated or [b"0"])[0]), fields.get(b"warc-payload-digest", b"sha1:").decode()[5:]
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def _page(fields: dict, key: bytes) -> int | None:
    v = fields.get(key, b"").decode(errors="replace").strip("<>").removeprefix(ID)
    return int(v) if v.lstrip("-").isdigit() else None


_CHUNK = "file string, block long, rel long"
_FOUND = f"{_CHUNK}, next_rel long, exit_rel long, total long, whole boolean, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, rel, chunk): rel counts the block's chunks and version lines so far."""
    now, rel = None, 0
    for b in batches:
        for f, k, v in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value")):
            if (f, k) != now:
                now, rel = (f, k), 0
            chunk = v.as_py() or b""
            yield f, k, rel, chunk
            rel += len(chunk) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    names = [x.split()[0] for x in _FOUND.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def close() -> pa.RecordBatch:
        # From the last chunk back: where each chain leaves the block.
        total = held[-1]["rel"] + held[-1].pop("size") + len(MAGIC)
        exits: dict[int, int | None] = {}
        for row in reversed(held):
            row.pop("size", None)
            n = row["next_rel"]
            exits[row["rel"]] = None if n is None else n if n >= total else exits.get(n)
            row["exit_rel"], row["total"] = exits[row["rel"]], total
        out = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], t) for c, t in zip(names, types)], names=names)
        held.clear()
        return out

    for f, k, rel, chunk in _numbered(batches):
        if held and (held[0]["file"], held[0]["block"]) != (f, k):
            yield close()
        row = {"file": f, "block": k, "rel": rel, "size": len(chunk), "next_rel": None, "whole": False}
        if fields := _parsed(chunk):
            size = fields["head"] + fields["length"]
            row["next_rel"] = rel + len(MAGIC) + size + 4
            row["record_type"], row["page_id"], row["refers_to"] = fields[b"warc-type"].decode(errors="replace"), _page(fields, b"warc-record-id"), _page(fields, b"warc-refers-to")
            if len(chunk) == size + 4 and chunk.endswith(b"\r\n\r\n"):
                row["whole"] = True
                row["payload_bytes"], row["payload_digest"] = _payload(fields, chunk[fields["head"] : size])
        held.append(row)
    if held:
        yield close()


def _reached(spots: DataFrame, blocks: int) -> DataFrame:
    """(file, at): the offsets at which chains from the files' starts enter blocks.

    spots: candidates as (file, at, exit). Only exits' targets and starts can be
    entries. Each round adds what one jump reaches and doubles the jumps.
    """
    starts = spots.where("at = 0").select("file", "at")
    targets = spots.where("exit IS NOT NULL").select("file", F.col("exit").alias("at")).unionByName(starts).distinct()
    jumps = durable(spots.join(targets, ["file", "at"], "left_semi").where("exit IS NOT NULL").select("file", "at", "exit"))
    reached = durable(starts)
    rounds = max(1, blocks).bit_length()
    for _ in range(rounds):
        more = jumps.join(reached, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = durable(reached.unionByName(more).distinct())
        ahead = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("ahead"))
        jumps = durable(jumps.join(ahead, ["file", "exit"]).select("file", "at", F.col("ahead").alias("exit")))
        if jumps.isEmpty():
            break
    return reached


def _walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block on the chain from its entry."""
    entry = pdf["entry"].iloc[0]
    row_of = dict(zip(pdf["at"], range(len(pdf))))
    follow = pdf["next"].to_numpy()
    keep, at = [], entry
    while at in row_of:
        keep.append(row_of[at])
        at = follow[row_of[at]]
    return pdf.iloc[keep]


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of an archive folder's records.

    Rows are durable when this returns; the archives may then go.
    """
    found = durable(_chunks(spark, path).mapInArrow(_candidates, _FOUND))
    sizes = found.select("file", "block", "total").distinct()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A file's first chunk is what precedes its first version line.
    bases = durable(sizes.select("file", "block", (F.coalesce(F.sum("total").over(before), F.lit(0)) - len(MAGIC)).alias("base")))
    blocks = bases.groupBy("file").count().agg(F.max("count")).head()[0] or 0
    at = found.join(small(bases), ["file", "block"]).where("next_rel IS NOT NULL AND base + rel >= 0")
    at = at.select("*", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("next_rel")).alias("next"), (F.col("base") + F.col("exit_rel")).alias("exit"))
    reached = _reached(at.select("file", "at", "exit"), blocks)
    entries = at.select("file", "block", "at").join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    columns = ["file", "at", "next", "whole", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    inside = at.select(*columns, "block").join(entries, ["file", "block"])
    kinds = {"file": "string", "whole": "boolean", "record_type": "string", "payload_digest": "string"}
    true = durable(inside.groupBy("file", "block").applyInPandas(lambda k, p: _nulls(_walk(k, p)[columns]), ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns)))
    out = true.where("whole")
    if not (split := true.where("NOT whole")).isEmpty():
        out = out.unionByName(_rejoined(spark, path, split, bases).select(*out.columns))
    return durable(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def _nulls(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.astype({c: "Int64" for c in pdf.columns if pdf[c].dtype.kind == "f"})


def _rejoined(spark: SparkSession, path: str, split: DataFrame, bases: DataFrame) -> DataFrame:
    """Records whose payloads hold version lines: their parts, gathered by record.

    Parts are found by the cell of the archive they start in, so no file's parts meet
    in one task; a record's own parts do, as its payload must be whole to be hashed.
    """
    spans = split.withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / CELL), F.floor((F.col("next") - 1) / CELL)))).select("file", "cell", "at", "next")

    def emit(batches):
        for f, k, rel, chunk in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([k], pa.int64()), pa.array([rel], pa.int64()), pa.array([chunk], pa.binary())], names=["file", "block", "rel", "value"])

    parts = _chunks(spark, path).mapInArrow(emit, f"{_CHUNK}, value binary").join(small(bases), ["file", "block"])
    parts = parts.select("file", (F.col("base") + F.col("rel")).alias("from"), "value").withColumn("cell", F.floor(F.col("from") / CELL))
    wanted = parts.join(small(durable(spans)), ["file", "cell"]).where("from >= at AND from < next")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = MAGIC.encode().join(pdf.sort_values("from")["value"])
        fields = _parsed(raw)
        n, d = _payload(fields, raw[fields["head"] : fields["head"] + fields["length"]])
        return pd.DataFrame({"file": [key[0]], "at": [key[1]], "n": [n], "d": [d]})

    done = wanted.groupBy("file", "at").applyInPandas(whole, "file string, at long, n long, d string")
    return split.drop("payload_bytes", "payload_digest").join(done, ["file", "at"]).withColumnsRenamed({"n": "payload_bytes", "d": "payload_digest"})


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """``pages`` written to archives in the shared folder (or kept in ``folder``) and read back.

    A row per page, repeated rows too; other columns are ignored, whatever their names. A
    null html is the empty payload, a null page_id comes back null and is smaller than any,
    a null url is empty. A very long payload, version lines in it or not, comes back whole.
    No rows give no rows.
    """
    spark = pages.sparkSession
    path = folder or f"{shared_dir(spark)}/quern-warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    try:
        return read(spark, path)
    finally:
        if not folder:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


