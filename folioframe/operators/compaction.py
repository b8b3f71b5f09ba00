"""Far too many small files: consolidate their records into few well-sized files.

Records are decoded from each small file (JSON documents, arrays and JSON
lines; of a half-written file all complete objects), repeated deliveries are
reduced to the last one, source files are dealt to a fixed number of output
groups longest-first with a least-loaded heap, every group is streamed to one
parquet file through pyarrow, and a manifest is published in one rename after
the written files have been read back and compared. The records of a file
larger than an output file are cut by hash into parts that are dealt one by one.

Defined results: null, blank and unreadable contents hold no records; objects
without a key are kept, equal ones once; equal file paths are told apart by
``file_id``, null file ids count as -1; ties of ``modified_at`` go to the larger
file id, then the later position.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.plans.staging import drop_folder, new_folder, rename_folder, spread, stage

KEY = ["file_kind", "doc_name", "page", "record_key", "nameless"]
#: Files per scheduling shard: files are hashed into as many shards as keep one heap (one task) at about this many.
SHARD_FILES = 200_000
#: Bytes of text that a writer gathers before it writes a row group.
ROW_GROUP_BYTES = 32 << 20
RECORDS_SCHEMA = (
    "file_id bigint, file_kind string, doc_name string, page bigint, modified_at timestamp, "
    "pos bigint, record_key string, nameless string, body string"
)

_SKIP = re.compile(r"[\s,\[\]﻿]*")


def records_of(content: str | None) -> Iterator[dict]:
    """Complete top-level objects of one small file, in order."""
    if content is None:
        return
    decode = json.JSONDecoder().raw_decode
    at, n = 0, len(content)
    while True:
        at = _SKIP.match(content, at).end()
        if at >= n:
            return
        try:
            got, at = decode(content, at)
            if isinstance(got, dict):
                yield got
        except (ValueError, RecursionError):
            # a broken object: in JSON lines the next record starts at the next line that opens at column 0
            nxt = content.find("\n{", at)
            if nxt < 0:
                return
            at = nxt + 1


def record_key(kind: str | None, record: dict) -> str | None:
    if kind == "judge":
        image = record.get("image")
        return re.split(r"[/\\]", image.strip())[-1] or None if isinstance(image, str) else None
    qa = record.get("qa_id")
    return None if qa is None else str(qa)


def decode_files(files: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for fid, kind, doc, page, at, content in zip(
                b["file_id"], b["file_kind"], b["doc_name"], b["page"], b["modified_at"], b["content"]
            ):
                page = None if page is None or page != page else int(page)
                for pos, rec in enumerate(records_of(content)):
                    key = record_key(kind, rec)
                    body = json.dumps(rec, ensure_ascii=False, sort_keys=True)
                    rows.append((fid, kind, doc, page, at, pos, key, body if key is None else None, body))
            out = pd.DataFrame(
                rows, columns=[c.split()[0] for c in RECORDS_SCHEMA.split(", ")]
            )
            out["page"] = out["page"].astype("Int64")
            yield out

    cols = ["file_kind", "doc_name", "page", "modified_at", "content"]
    known = files.select(F.coalesce(F.col("file_id").cast("bigint"), F.lit(-1)).alias("file_id"), *cols).filter("content is not null")
    return spread(known).mapInPandas(run, RECORDS_SCHEMA)


def last_records(records: DataFrame) -> DataFrame:
    """One row per record: its last delivery."""
    # max_by keeps the payload of the winner only; map-side combine drops copies before the shuffle
    order = F.struct(F.coalesce("modified_at", F.lit(0).cast("timestamp")), "file_id", "pos")
    best = F.max_by(F.struct("file_id", "pos", "modified_at", "body"), order)
    return records.groupBy(*KEY).agg(best.alias("w")).select(*KEY, "w.*")


def longest_first(loads: list[tuple], groups: int) -> dict:
    """unit -> group: longest unit first, always to the least-loaded group (ties: lower id)."""
    heap = [(0, g) for g in range(groups)]
    out = {}
    for unit, size in sorted(loads, key=lambda x: (-x[1], x[0])):
        load, g = heapq.heappop(heap)
        out[unit] = g
        heapq.heappush(heap, (load + size, g))
    return out


def parted(sizes: DataFrame, target_bytes: int) -> DataFrame:
    """file_id, size -> file_id, part, n_parts, size: a file above ``target_bytes`` in as many parts as it fills groups."""
    n = F.greatest(F.ceil(F.col("size") / target_bytes), F.lit(1)).cast("int")
    cut = sizes.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    return cut.withColumn("size", F.ceil(F.col("size") / F.col("n_parts")).cast("bigint"))


def schedule(loads: DataFrame, target_bytes: int, shards: int) -> DataFrame:
    """file_id, part, size -> file_id, part, n_parts, out_group. Units are hashed into shards; each shard deals its units to the groups its load fills, with its own heap."""

    def run(pdf):
        import pandas as pd

        units = list(zip(pdf["file_id"], pdf["part"]))
        dealt = longest_first(list(zip(units, pdf["size"])), int(pdf["n_groups"].iloc[0]))
        first = int(pdf["first_group"].iloc[0])
        return pd.DataFrame(
            {
                "file_id": pdf["file_id"], "part": pdf["part"], "n_parts": pdf["n_parts"],
                "out_group": [first + dealt[u] for u in units],
            }
        )

    keyed = loads.withColumn("shard", F.pmod(F.xxhash64("file_id", "part"), F.lit(shards)))
    groups = keyed.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / target_bytes)).alias("n_groups"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    groups = groups.withColumn("first_group", F.coalesce(F.sum("n_groups").over(before), F.lit(0)))
    return keyed.join(groups, "shard").groupBy("shard").applyInPandas(run, "file_id bigint, part int, n_parts int, out_group int")


def _writer(folder: str):
    """Streams rows sorted by group into one parquet file per group; gives one manifest row per file."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        done, now = [], None

        def flush():
            if now["held"]:
                now["writer"].write_table(pa.concat_tables(now["held"]))
                now["held"], now["bytes"] = [], 0

        def close():
            flush()
            now["writer"].close()
            now["sink"].close()
            size = system.get_file_info(f"{base}/{now['name']}").size
            done.append((now["group"], now["name"], now["rows"], size, now["sum"]))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            groups = t.column("out_group").to_numpy()
            start = 0
            while start < len(groups):
                g = int(groups[start])
                stop = int(groups.searchsorted(g, "right"))
                piece = t.slice(start, stop - start)
                keep = piece.drop_columns(["out_group", "check"])
                if now is None or now["group"] != g:
                    if now is not None:
                        close()
                    name = f"part-{g:06d}-{uuid.uuid4().hex}.parquet"
                    sink = system.open_output_stream(f"{base}/{name}")
                    now = {"group": g, "name": name, "rows": 0, "sum": 0, "sink": sink, "held": [], "bytes": 0}
                    now["writer"] = pq.ParquetWriter(sink, keep.schema, compression="zstd")
                now["held"].append(keep)
                now["bytes"] += keep.nbytes
                if now["bytes"] >= ROW_GROUP_BYTES:
                    flush()
                now["rows"] += piece.num_rows
                now["sum"] = (now["sum"] + (pc.sum(piece.column("check")).as_py() or 0)) % (1 << 61)
                start = stop
        if now is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            {
                "out_group": pa.array([d[0] for d in done], pa.int64()),
                "file_name": pa.array([d[1] for d in done], pa.string()),
                "n_records": pa.array([d[2] for d in done], pa.int64()),
                "n_bytes": pa.array([d[3] for d in done], pa.int64()),
                "checksum": pa.array([d[4] for d in done], pa.int64()),
            }
        )

    return run


def _checksum():
    return F.pmod(F.xxhash64("file_kind", "doc_name", "page", "record_key", "body"), F.lit(1 << 40))


def consolidate(
    files: DataFrame, out_dir: str | None = None, target_bytes: int = 256 << 20, shard_files: int = SHARD_FILES
) -> str:
    """Write the records of ``files`` into few files of about ``target_bytes`` text each; gives the folder.

    The folder holds ``data/*.parquet`` and ``manifest`` (parquet: out_group,
    file_name, n_records, n_bytes, checksum). Every output group is written by
    its own task. ``manifest`` appears in one rename, only after the data was
    read back and equals what was to be written.
    """
    spark = files.sparkSession
    out_dir = out_dir or new_folder(spark, "consolidated")
    records = stage(last_records(decode_files(files)), "records")
    sizes = records.groupBy("file_id").agg(F.sum(F.length("body")).cast("bigint").alias("size"))
    loads = stage(parted(sizes, target_bytes), "loads")
    shards = max(1, math.ceil(loads.count() / shard_files))
    plan = stage(schedule(loads, target_bytes, shards), "schedule")
    n_groups = (plan.agg(F.max("out_group")).first()[0] or 0) + 1
    whole = plan.filter("n_parts = 1").select("file_id", "out_group")
    part = F.pmod(F.xxhash64("file_id", "pos"), F.col("n_parts")).cast("int")
    cut = plan.filter("n_parts > 1").select("file_id", F.col("n_parts"), F.struct("part", "out_group").alias("u"))
    cut = cut.groupBy("file_id").agg(F.max("n_parts").alias("n_parts"), F.transform(F.array_sort(F.collect_list("u")), lambda x: x["out_group"]).alias("dealt"))
    both = whole.select("file_id", F.lit(1).alias("n_parts"), F.array("out_group").alias("dealt")).unionByName(cut)
    placed = (
        records.join(both, "file_id")
        .withColumn("out_group", F.get("dealt", part))
        .withColumn("check", _checksum())
        .select("file_kind", "doc_name", "page", "record_key", "modified_at", "file_id", "body", "out_group", "check")
        .repartitionById(n_groups, "out_group")
        .sortWithinPartitions("out_group", "file_id")
    )
    data = f"{out_dir}/data"
    path = spark._jvm.org.apache.hadoop.fs.Path(data)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    schema = "out_group bigint, file_name string, n_records bigint, n_bytes bigint, checksum bigint"
    written = stage(placed.mapInArrow(_writer(data), schema), "written-groups")
    _verify(spark, data, written, records)
    waiting = f"{out_dir}/_manifest_{uuid.uuid4().hex}"
    written.coalesce(1).write.parquet(waiting)  # a row per output file
    rename_folder(spark, waiting, f"{out_dir}/manifest")
    return out_dir


def _verify(spark: SparkSession, data: str, manifest: DataFrame, records: DataFrame) -> None:
    want = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(_checksum()), F.lit(0)).alias("s")).first()
    listed = manifest.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.count("*")).first()
    if listed[0] != want["n"]:
        raise ValueError(f"manifest lists {listed[0]} records of {want['n']}")
    if not listed[1]:
        return
    back = _read(spark, data, manifest)
    got = back.withColumn("c", _checksum()).groupBy("file_name").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
    bad = (
        manifest.join(got, "file_name", "left")
        .filter("n is null or n <> n_records or s % 2305843009213693952 <> checksum")
        .limit(1)
        .count()
    )
    if bad:
        raise ValueError("a consolidated file differs from what was written")
    if got.agg(F.sum("s")).first()[0] != want["s"]:
        raise ValueError("records were lost or doubled")


def _read(spark: SparkSession, data: str, manifest: DataFrame) -> DataFrame:
    """Rows of the listed files; files left behind by lost attempts are not listed."""
    schema = "file_kind string, doc_name string, page bigint, record_key string, modified_at timestamp, file_id bigint, body string"
    rows = spark.read.schema(schema).parquet(data).withColumn("file_name", F.col("_metadata.file_name"))
    return rows.join(manifest.select("file_name"), "file_name", "left_semi")


def read_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    manifest = spark.read.parquet(f"{folder}/manifest")
    if manifest.limit(1).count() == 0:
        schema = "file_name string, file_kind string, doc_name string, page bigint, record_key string, modified_at timestamp, file_id bigint, body string"
        return spark.createDataFrame([], schema)
    return _read(spark, f"{folder}/data", manifest)


def consolidated_keys(files: DataFrame, target_bytes: int = 256 << 20) -> DataFrame:
    """Consolidate, then list the records of the published files."""
    folder = consolidate(files, target_bytes=target_bytes)
    out = read_consolidated(files.sparkSession, folder)
    return out.select("file_kind", "doc_name", "page", "record_key").distinct()


def forget(spark: SparkSession, folder: str) -> None:
    drop_folder(spark, folder)
