"""WARC archives: write, read back, and merge their indexes into capture histories.

Writing: every row becomes one WARC record (response, or revisit where an equal
payload of some size is kept by another record). Spark's text writer writes the
records: the end of a line is the end of a WARC record (two CRLFs), so that a
part file is a WARC file. Files hold about ``file_bytes`` of records.

Reading: gzipped files are read as a stream of lines that are put together by
Content-Length, so that a task holds one record at a time, however large the file is.

Index: each archive gives a locally sorted run of (url key, timestamp, ...).
Runs are merged externally: the key space is cut into ranges at sampled keys,
every run's slice of a range goes to the same task, and a loser tree merges the
slices of the k runs there. Ranges follow each other, so that range and place
order all captures globally, and the captures of a url are numbered across
the ranges that they span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

CRLF = "\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT_BYTES = 1000

RECORD = "record_type string, id string, uri string, at string, digest string, refers_to string, length bigint, payload binary, own string, file string, start bigint"


def with_revisits(pages: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Adds payload_bytes, payload_digest (bare hex SHA-1), record_type and refers_to.

    Of rows with equal payloads of at least ``least`` bytes, those with the
    largest key are responses (one row, unless the key repeats), all others are
    revisits that refer to it. Rows with a null key are revisits of a row that
    has one, else responses. Null payloads are empty.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    sized = pages.withColumn("payload_bytes", F.octet_length(body).cast("bigint")).withColumn("payload_digest", F.sha1(body.cast("binary")))
    keepers = (
        sized.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("__d"))
        .agg(F.max(key).alias("__kept"), F.count("*").alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    joined = sized.join(keepers, (F.col("payload_digest") == F.col("__d")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("__kept").isNotNull() & ~F.col(key).eqNullSafe(F.col("__kept"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("__kept"))).drop("__d", "__kept")


def record_text(key: Column, uri: Column, at: Column, payload: Column) -> Column:
    """One WARC record without its closing CRLFs. Revisits have no payload."""
    revisit = F.col("record_type") == "revisit"
    clean = F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "%0A")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("record_type"), F.lit(CRLF + "WARC-Record-ID: <urn:row:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">" + CRLF + "WARC-Target-URI: "), clean,
        F.lit(CRLF + "WARC-Date: "), at, F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:row:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(END),
    )
    return F.concat(header, F.when(revisit, F.lit("")).otherwise(F.coalesce(payload, F.lit(""))))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", at: Column | None = None, file_bytes: int = 64 << 20, gzip: bool = True) -> None:
    """Write a record for each row of ``pages`` under ``folder`` (any file system that Spark writes; part files are WARC files, gzipped as a whole).

    ``at``: the capture's time as WARC text; the same fixed date for all rows where it isn't given.
    ``file_bytes``: a file ends behind as many records as have that size on average.
    """
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length(payload).cast("bigint"))).first()
    per_file = max(1, file_bytes * n // ((size or 0) + 500 * max(1, n)))  # headers have about 500 bytes
    records = with_revisits(pages.select(key, uri, payload), key, payload)
    body = record_text(F.col(key), F.col(uri), at if at is not None else F.lit(DATE), F.col(payload))
    (
        records.select(body.alias("value")).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", int(per_file))
        .option("compression", "gzip" if gzip else "none").text(folder)
    )


class RecordStream:
    """Cuts a WARC file that comes in chunks into records: headers (names in lower case), payload, and where the record starts."""

    def __init__(self):
        self.chunks: list[bytes] = []
        self.size, self.begin, self.need = 0, 0, 4

    def feed(self, chunk: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
        self.chunks.append(chunk)
        self.size += len(chunk)
        if self.size < self.need:
            return
        data = self.chunks[0] if len(self.chunks) == 1 else b"".join(self.chunks)
        at, self.need = 0, 4
        while len(data) - at >= self.need:
            head = data.find(b"\r\n\r\n", at)
            if head < 0:
                self.need = len(data) - at + 1
                break
            if not data.startswith(b"WARC/", at):
                raise ValueError(f"no WARC record at byte {self.begin}")
            lines = data[at:head].decode("utf-8", "replace").split(CRLF)[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            end = head + 4 + int(headers["content-length"])
            if len(data) < end + 4:
                self.need = end + 4 - at
                break
            yield headers, data[head + 4 : end], self.begin
            self.begin += end + 4 - at
            at = end + 4
        self.chunks, self.size = [data[at:] if at else data], len(data) - at  # what is left is copied once a chunk

    def close(self) -> None:
        if self.size:
            raise ValueError(f"a WARC record that starts at byte {self.begin} isn't complete")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Records of a whole WARC file."""
    stream = RecordStream()
    yield from stream.feed(data)
    stream.close()


def read_warc(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC files in ``folder``: record_type, id, uri, at, digest, refers_to, length, payload (null without ``payloads``), own (the SHA-1 of the payload of a response), file and start (of the record in the unpacked file).

    Files whose name ends in .gz are streamed; others are taken as they are, each whole.
    """
    import hashlib

    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in RECORD.split(", ")]
    plain = lambda x: x.removeprefix("<urn:row:").removesuffix(">") if x is not None else None

    def reader(between: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stream, last, rows, size = RecordStream(), None, [], 0
            for batch in batches:
                paths, values = batch.column(0).to_pylist(), batch.column(1)
                for path, value in zip(paths, values):
                    if path != last:
                        stream.close()
                        stream, last = RecordStream(), path
                    for h, body, start in stream.feed(value.as_buffer().to_pybytes() + between):
                        own = hashlib.sha1(body).hexdigest() if h["warc-type"] == "response" else None
                        rows.append((h["warc-type"], plain(h["warc-record-id"]), h["warc-target-uri"], h["warc-date"], h["warc-payload-digest"].removeprefix("sha1:"), plain(h.get("warc-refers-to")), len(body), body if payloads else None, own, path, start))
                        size += len(body) if payloads else 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
            stream.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        return run

    packed = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(folder).select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "part-*[!z]").load(folder).select("path", "content")
    return packed.mapInArrow(reader(b"\n"), RECORD).unionByName(whole.mapInArrow(reader(b""), RECORD))


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: a tree of losers finds each next least item with one comparison a level."""
    k = len(runs)
    if not k:
        return
    place = [0] * k
    head: list[tuple | None] = [r[0] if r else None for r in runs]

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; equal heads by run, exhausted runs last."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while head[best] is not None:
        yield head[best]
        place[best] += 1
        head[best] = runs[best][place[best]] if place[best] < len(runs[best]) else None
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def url_key(uri: Column) -> Column:
    """The url as a sort key: host labels from the last to the first, then the rest, A-Z lower-cased in the host."""
    host = F.lower(F.regexp_extract(uri, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(uri, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.instr(uri, "://") > 0, F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)).otherwise(F.coalesce(uri, F.lit("")))


INDEX = "range bigint, place bigint, urlkey string, at string, id string, file string, start bigint, digest string, record_type string, refers_to string, length bigint, own string, capture bigint, edge boolean"


def merge_indexes(records: DataFrame, per_range: int | None = None) -> DataFrame:
    """All captures in global order: place (from 0), urlkey, at, id, file, start, digest, record_type, refers_to, length, own, capture (its number among those of the url, from 1) and range.

    ``records``: rows as ``read_warc`` gives them. A file's captures, sorted,
    are a run. Ranges hold about ``per_range`` captures (by default 20,000, and in archives of more than 80 million
    captures as many as make 4096 ranges, up to half a million): they are cut by url
    key, time, file and start together, so that one url's captures can span
    ranges. Equal captures keep the order of file and start.
    """
    order = ["urlkey", "at", "file", "start"]
    fields = ["id", "digest", "record_type", "refers_to", "length", "own"]
    runs = tx.stored(records.select(url_key(F.col("uri")).alias("urlkey"), "at", "file", "start", *fields).sortWithinPartitions("file", *order))
    n = runs.count()
    ranges = max(1, -(-n // (per_range or min(500_000, max(20_000, n // 4096)))))
    # repartitionByRange samples keys and cuts; sorting by file puts each run's slice together again
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("file", *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                slices.setdefault(row[2], []).append(row)
        number, rows = TaskContext.get().partitionId(), []
        for urlkey, at, file, start, id_, *rest in loser_tree([slices[f] for f in sorted(slices)]):
            capture = rows[-1][12] + 1 if rows and rows[-1][2] == urlkey else 1
            rows.append((number, len(rows), urlkey, at, id_, file, start, *rest, capture))
        names = [f.split()[0] for f in INDEX.split(", ")]
        types = [pa.int64() if f.endswith("bigint") else pa.bool_() if f.endswith("boolean") else pa.string() for f in INDEX.split(", ")]
        # the last captures of the range's first and last url tell how many of them the range has
        edge = [b is None or (a[2] != b[2] and a[2] == rows[0][2]) for a, b in zip(rows, [*rows[1:], None])]
        for k in range(0, len(rows), 10_000):
            some = [*zip(*rows[k : k + 10_000]), edge[k : k + 10_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, types)], names=names)

    merged = tx.stored(dealt.mapInArrow(merge, INDEX))
    # one row a range: how many captures come before it; two at most: how many of its first url's do
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = merged.groupBy("range").agg(F.count("*").alias("n")).select(F.col("range").alias("__r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    same = Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = merged.where("edge").select(F.col("range").alias("__cr"), F.col("urlkey").alias("__u"), F.sum("capture").over(same).alias("__carried")).where("__carried is not null")
    numbered = merged.join(offset, F.col("range") == F.col("__r")).join(carried, (F.col("range") == F.col("__cr")) & (F.col("urlkey") == F.col("__u")), "left")
    return numbered.select("range", (F.col("place") + F.col("__before")).alias("place"), "urlkey", "at", "id", "file", "start", *fields[1:], (F.col("capture") + F.coalesce("__carried", F.lit(0))).alias("capture"))


def captures(index: DataFrame, key: str = "page_id", kind: str = "bigint") -> DataFrame:
    """One row per capture of the merged index, with what the archives say of it.

    Key, payload_bytes and payload_digest (of the full payload: a revisit's are
    those of the response with that digest that it refers to; a response's
    digest is that of the payload read), record_type, refers_to, urlkey, place and capture.
    """
    whole = F.col("own").isNotNull() & (F.col("length") >= LEAST_REVISIT_BYTES) & (F.col("id") != "")
    kept = index.where(whole).groupBy(F.col("id").alias("kept"), F.col("own").alias("full_digest")).agg(F.max("length").alias("full"))
    joined = index.join(kept, (F.col("refers_to") == F.col("kept")) & (F.col("digest") == F.col("full_digest")), "left")
    return joined.select(
        F.when(F.col("id") != "", F.col("id")).cast(kind).alias(key), F.coalesce("full", "length").alias("payload_bytes"), F.coalesce("full_digest", "own").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
        "urlkey", "place", "capture",
    )


def archive(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", at: Column | None = None) -> DataFrame:
    """Write ``pages`` as WARC files, read them back, merge their indexes, and return the captures.

    Null payloads are empty, null urls have an empty uri, null keys an empty id
    (read back as null). Repeated rows are a record each. An empty table gives
    no captures. A payload of any length is one record. Of the columns of
    ``pages`` only the three named are archived.
    """
    write_warc(pages, folder, key, uri, payload, at)
    records = read_warc(pages.sparkSession, folder, payloads=False)
    return captures(merge_indexes(records), key, pages.schema[key].dataType.simpleString())
