"""Web archives and their Merkle fixity audit.

Pages become WARC records, laid end to end in archives of bounded size (gzip files that any WARC reader opens), with a
manifest of each record's offset range. A replica is audited against the manifest: the bytes of each range are hashed, hashes
are combined along the ordered ranges into a tree for each archive and on over the archives to one root, and the trees
of two replicas are compared from the root down. Only children of differing nodes are looked at, down to the records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder, stage
from .common import map_columns, read

FAN_BITS = 4
GROUPS = 256
BATCH_SETTING, FILES_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "4"
ID_BITS = 9
DATE = "2024-01-01T00:00:00Z"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a resource record; null urls and bodies are empty. Its UTF-8 bytes are the record."""
    body = F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"),
        name,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def lay_out(pages: DataFrame, *, id_bits: int = ID_BITS, rows: int = 4096) -> DataFrame:
    """``pages`` as records: page_id, url, archive, slot (from 0), slots (of the archive), start, stop and the record's text.

    An archive holds a run of 2^id_bits ids; a run of more than ``rows`` rows (repeated or null ids) is dealt by content to several.
    Within an archive records are ordered by id, url and digest; equal rows are records of their own. An archive is laid out in one
    task, and without the text only sizes and digests move.
    """
    run = F.coalesce(F.shiftright("page_id", id_bits), F.lit(-1))
    records = pages.select("page_id", "url", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), run.alias("run"))
    records = records.withColumns({"size": F.octet_length("record").cast("long"), "digest": F.sha2(F.col("record").cast("binary"), 256)})
    big = records.groupBy("run").agg((F.floor(F.count(F.lit(1)) / rows) + 1).alias("parts"))
    records = records.join(big, "run")
    records = records.withColumn("part", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("parts")))
    whole = Window.partitionBy("run", "part")
    w = whole.orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest")
    stop = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    records = records.withColumns({"slot": F.row_number().over(w) - 1, "stop": stop, "slots": F.count(F.lit(1)).over(whole)})
    archive = F.concat(F.col("run").cast("string"), F.lit("-"), F.col("part").cast("string"))
    return records.select(archive.alias("archive"), "slot", "slots", "page_id", "url", (F.col("stop") - F.col("size")).alias("start"), "stop", "record")


def write_archives(records: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """One gzip file per archive under ``path/archive=…``, its records in slot order; folders of ``by`` come first.

    ``records`` have each archive in one task, as :func:`lay_out` leaves them.

    A text row ends with a line feed, so a record is written without its own last one: the file is exactly the records end to
    end.
    """
    lines = records.select(*by, "archive", "slot", F.expr("substring(record, 1, length(record) - 1)").alias("value"))
    lines = lines.sortWithinPartitions(*by, "archive", "slot").drop("slot")
    lines.write.partitionBy(*by, "archive").option("compression", "gzip").text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")


def _unzip(content: bytes) -> bytes:
    """The readable bytes of a gzip file; of a damaged one, what comes before the damage."""
    try:
        return gzip.decompress(content)
    except (OSError, EOFError, zlib.error):
        reader = zlib.decompressobj(31)
        try:
            return reader.decompress(content)
        except zlib.error:
            return b""


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: archive, start, stop, url, body; a record that does not parse ends its file."""
    schema = T.StructType.fromDDL("archive string, records array<struct<start:long,stop:long,url:string,body:string>>")

    def parse(rows):
        return {"records": [list(parse_records(_unzip(c))) for c in rows["content"]]}

    parsed = map_columns(_archives(spark, path), parse, schema)
    return parsed.select("archive", F.explode("records").alias("r")).select("archive", "r.*")


def parse_records(data: bytes):
    at = 0
    while data.startswith(b"WARC/1.0\r\n", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = fields.get("Content-Length", "")
        if not size.isdigit() or end + 4 + int(size) + 4 > len(data):
            return
        body = data[end + 4 : end + 4 + int(size)]
        stop = end + 4 + int(size) + 4
        yield {"start": at, "stop": stop, "url": fields.get("WARC-Target-URI", ""), "body": body.decode("utf-8", "replace")}
        at = stop


def hash_ranges(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The leaves of a replica: archive, slot, start, stop, hash and how many bytes of the range the replica holds.

    The offset ranges come from the manifest, so damage in place and lost tails stay where they are. The ranges of an archive
    (a bounded number) travel to its file. An archive without a file has leaves of no bytes. The leaves are written to the shared
    folder and read back: whole files go to Python a few at a time, which is a setting of the running job.
    """
    ranges = manifest.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("slot", "start", "stop"))).alias("ranges"))
    archives = _archives(spark, path)
    files = archives.join(ranges.hint("shuffle_hash"), "archive")
    lost = ranges.join(archives.select("archive"), "archive", "left_anti")
    leaf = "array<struct<slot:int,start:long,stop:long,hash:string,held:long>>"

    def leaves(rows):
        made = []
        for content, ranges in zip(rows["content"], rows["ranges"]):
            data = memoryview(_unzip(content))
            part = [(r, data[r["start"] : r["stop"]]) for r in ranges]
            made.append([{**r, "hash": hashlib.sha256(b).hexdigest(), "held": len(b)} for r, b in part])
        return {"leaves": made}

    out = map_columns(files, leaves, T.StructType.fromDDL(f"archive string, leaves {leaf}"))
    out = out.select("archive", F.explode("leaves").alias("l")).select("archive", "l.*")
    empty = lost.select("archive", F.explode("ranges").alias("r")).select(
        "archive", "r.*", F.lit(hashlib.sha256().hexdigest()).alias("hash"), F.lit(0).cast("long").alias("held")
    )
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, FILES_PER_BATCH)
    try:
        return stage(out.unionByName(empty), "warc-leaves")
    finally:
        spark.conf.set(BATCH_SETTING, before)


def build_tree(leaves: DataFrame, fan_bits: int = FAN_BITS) -> list[DataFrame]:
    """Levels from the leaves to the root: archive, node, start, stop, hash; in the two top levels without archive and range.

    A node of an archive is (archive, slot >> k·bits) at level k, up to the archive's root. Above, archives are gathered in groups by
    a hash of their names, and the groups under one root. Each node hashes its children's hashes in order.
    """
    depth = max(1, -(-int(leaves.agg(F.max("slot")).first()[0] or 0).bit_length() // fan_bits))
    levels = [leaves.select("archive", F.col("slot").cast("long").alias("node"), "start", "stop", "hash")]
    for k in range(depth):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))["hash"]
        level = levels[-1].groupBy("archive", F.shiftright("node", fan_bits).alias("node")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), _hash_of(children).alias("hash")
        )
        levels.append(stage(level, "warc-nodes") if k in (0, depth - 1) else level)
    roots = F.array_sort(F.collect_list(F.struct("archive", "hash")))["hash"]
    groups = levels[-1].groupBy(_group().alias("node")).agg(_hash_of(roots).alias("hash"))
    root = groups.groupBy(F.lit(0).cast("long").alias("node")).agg(_hash_of(F.array_sort(F.collect_list(F.struct("node", "hash")))["hash"]).alias("hash"))
    return [*levels, groups, root]


def _group() -> Column:
    return F.pmod(F.xxhash64("archive"), F.lit(GROUPS))


def _hash_of(children: Column) -> Column:
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


def audit(one: list[DataFrame], other: list[DataFrame], fan_bits: int = FAN_BITS) -> DataFrame:
    """Leaves (archive, slot, start, stop) at which two trees of the same manifest differ, found from the root down.

    Children are compared only below differing nodes; equal roots end the search with no rows.
    """
    top = len(one) - 1
    root = _differing(one[top], other[top], ["node"])
    below_root = one[top - 1].join(root.select(F.col("node").alias("__up")), F.lit(0) == F.col("__up"), "left_semi")
    groups = _differing(below_root, other[top - 1], ["node"])
    heads = one[top - 2].join(groups.select(F.col("node").alias("__up")), _group() == F.col("__up"), "left_semi")
    different = _differing(heads, other[top - 2], ["archive", "node"])
    for k in range(top - 3, -1, -1):
        up = different.select(F.col("archive").alias("__a"), F.col("node").alias("__up"))
        on = (F.col("archive") == F.col("__a")) & (F.shiftright("node", fan_bits) == F.col("__up"))
        different = _differing(one[k].join(up, on, "left_semi"), other[k], ["archive", "node"])
    return different.select("archive", F.col("node").cast("int").alias("slot"), "start", "stop")


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of ``a`` whose hash in ``b`` is another one, or that ``b`` lacks."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("hash").alias("__hash"))
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__{k}") for k in keys])
    return a.join(other, on, "left").filter(~F.col("hash").eqNullSafe(F.col("__hash"))).drop("__hash", *[f"__{k}" for k in keys])


def damaged(records: DataFrame, where: Column) -> DataFrame:
    """``records`` with faults in the rows ``where``, that follow from the rows: changed bytes in one record of 50, lost tails in one archive of 8."""
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 6), 16, 10).cast("long")
    lost = F.conv(F.substring(F.md5(F.col("archive").cast("binary")), 1, 6), 16, 10).cast("long") % 8 == 0
    changed = F.when(where & (draw % 50 == 0), F.overlay("record", F.lit("#"), 12 + draw % 20)).otherwise(F.col("record"))
    return records.filter(~(where & lost & (F.col("slot") == F.col("slots") - 1))).withColumn("record", changed)


def op8_warc_fixity(spark, sf_dir):
    """Archives of all pages in two replicas, the second with faults; the audit of their files locates every damaged record."""
    records = lay_out(read(spark, sf_dir, "pages"))
    manifest = stage(records.drop("record", "slots"), "warc-manifest")
    if manifest.isEmpty():  # no archives, and so no files to audit
        none = "archive string, slot int, page_id long, url string, start long, stop long, state string, sha256 string, found_sha256 string"
        return spark.createDataFrame([], none)
    folder = new_folder(spark, "warc-replicas")
    both = records.withColumn("replica", F.explode(F.array(F.lit("a"), F.lit("b"))))
    write_archives(damaged(both, F.col("replica") == "b"), folder, by=("replica",))
    leaves = [hash_ranges(spark, f"{folder}/replica={r}", manifest) for r in "ab"]
    found = audit(*[build_tree(x) for x in leaves])
    held = leaves[1].select("archive", "slot", "held", F.col("hash").alias("found_sha256"))
    good = leaves[0].select("archive", "slot", F.col("hash").alias("sha256"))
    out = found.join(manifest.select("archive", "slot", "page_id", "url"), ["archive", "slot"]).join(good, ["archive", "slot"]).join(held, ["archive", "slot"])
    state = F.when(F.col("held") == 0, "missing").when(F.col("held") < F.col("stop") - F.col("start"), "cut").otherwise("changed")
    return out.select("archive", "slot", "page_id", "url", "start", "stop", state.alias("state"), "sha256", "found_sha256")


ORACLE = r"""
WITH record AS (
  SELECT page_id, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:'
    || md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    (page_id >> 9)::VARCHAR || '-0' AS archive
  FROM pages
), laid AS (
  SELECT *, row_number() OVER w - 1 AS slot, sum(strlen(record)) OVER w AS stop, count(*) OVER (PARTITION BY archive) AS n,
    ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 6))::BIGINT AS draw, ('0x' || substr(md5(archive), 1, 6))::BIGINT % 8 = 0 AS lost
  FROM record WINDOW w AS (PARTITION BY archive ORDER BY page_id, url, sha256(record) ROWS UNBOUNDED PRECEDING)
), replica AS (
  SELECT *, CASE WHEN lost AND slot = n - 1 THEN '' WHEN draw % 50 = 0
    THEN substr(record, 1, (11 + draw % 20)::INT) || '#' || substr(record, (13 + draw % 20)::INT) ELSE record END AS found
  FROM laid
)
SELECT archive, slot::INT AS slot, page_id, url, (stop - strlen(record))::BIGINT AS start, stop::BIGINT AS stop,
  CASE WHEN found = '' THEN 'missing' ELSE 'changed' END AS state, sha256(record) AS sha256, sha256(found) AS found_sha256
FROM replica WHERE found <> record
"""

QUERIES = {"op8_warc_fixity": (op8_warc_fixity, ORACLE)}
