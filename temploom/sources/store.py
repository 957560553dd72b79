"""Catalog stores: Parquet plus a JSON description, replaced as a whole; in-memory, Redis and Kafka variants of the same protocol."""
from __future__ import annotations

import io
import json
import re
import tempfile
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from temploom.errors import CatalogDecodeError, StoreError, UnsupportedCatalogVersion
from temploom.operators.options import MinerOptions

FORMAT_VERSION = 2
CATALOG_DDL = (
    "id long, template string, tokens array<struct<text:string,lead:string,trail:string>>, size long, created_ms long, updated_ms long, event_first_ms long,"
    " event_last_ms long, suffix string, members array<string>, n_tokens int, leaf_keys array<string>, leaf_pos int, last_used long"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder that the session names in spark.checkpoint.dir; a local one only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise StoreError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="temploom-")
    return f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, that of the session's default file system where it has none, for readers that don't know that."""
    if "://" in path:
        return path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())


class CatalogStore(Protocol):
    def save(self, catalog: DataFrame, opts: MinerOptions, counter: int) -> None: ...
    def load(self, spark: SparkSession) -> tuple[DataFrame, dict] | None: ...


def _meta(opts: MinerOptions, counter: int) -> dict:
    return {"format_version": FORMAT_VERSION, "options": opts.to_json_dict(), "counter": counter}


def _checked(meta: dict) -> dict:
    if meta.get("format_version") not in (1, FORMAT_VERSION):
        raise UnsupportedCatalogVersion(f"catalog format {meta.get('format_version')!r}")
    return meta


def _upgraded(df: DataFrame) -> DataFrame:
    """Version 1 has no event window: absent columns are added as null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(CATALOG_DDL)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


class ParquetStore:
    """A folder on any Hadoop file system. ``CURRENT`` names the version folder; it is replaced by a rename after all is written."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession):
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(spark._jsc.hadoopConfiguration())

    def save(self, catalog: DataFrame, opts: MinerOptions, counter: int) -> None:
        spark = catalog.sparkSession
        jvm, fs = self._fs(spark)
        P, version = jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
        old = self._current(jvm, fs)
        catalog.write.parquet(f"{self.path}/{version}")
        tmp = P(f"{self.path}/CURRENT.{version}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(_meta(opts, counter) | {"version": version}).encode()))
        stream.hsync()
        stream.close()
        current = P(f"{self.path}/CURRENT")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, current, _overwrite(spark))
        if old:
            fs.delete(P(f"{self.path}/{old['version']}"), True)

    def _current(self, jvm, fs) -> dict | None:
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise CatalogDecodeError(str(e)) from e

    def load(self, spark: SparkSession) -> tuple[DataFrame, dict] | None:
        meta = self._current(*self._fs(spark))
        if meta is None:
            return None
        return _upgraded(spark.read.parquet(f"{self.path}/{_checked(meta)['version']}")), meta


def _overwrite(spark: SparkSession):
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    arr = spark._sc._gateway.new_array(rename, 1)
    arr[0] = rename.OVERWRITE
    return arr


def pack(catalog: DataFrame, meta: dict) -> bytes:
    """A catalog as one byte string for key-value back ends, which hold it whole in any case."""
    import pyarrow.parquet as pq

    buf = io.BytesIO()
    pq.write_table(catalog.toArrow().replace_schema_metadata({"meta": json.dumps(meta)}), buf)
    return buf.getvalue()


def unpack(spark: SparkSession, data: bytes) -> tuple[DataFrame, dict]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        table = pq.read_table(io.BytesIO(data))
        meta = json.loads(table.schema.metadata[b"meta"])
    except (pa.ArrowException, KeyError, TypeError, ValueError) as e:
        raise CatalogDecodeError(str(e)) from e
    return _upgraded(spark.createDataFrame(table.replace_schema_metadata(None))), _checked(meta)


class MemoryStore:
    def __init__(self) -> None:
        self.data: bytes | None = None

    def save(self, catalog: DataFrame, opts: MinerOptions, counter: int) -> None:
        self.data = pack(catalog, _meta(opts, counter))

    def load(self, spark: SparkSession) -> tuple[DataFrame, dict] | None:
        return None if self.data is None else unpack(spark, self.data)


class RedisStore:
    """One key, overwritten. Needs the ``redis`` client or any object with ``get`` and ``set``."""

    def __init__(self, key: str, url: str | None = None, client=None) -> None:
        if client is None:
            try:
                import redis
            except ImportError as e:
                raise StoreError("the redis client isn't installed") from e
            client = redis.Redis.from_url(url)
        self.key, self.client = key, client

    def save(self, catalog: DataFrame, opts: MinerOptions, counter: int) -> None:
        self.client.set(self.key, pack(catalog, _meta(opts, counter)))

    def load(self, spark: SparkSession) -> tuple[DataFrame, dict] | None:
        data = self.client.get(self.key)
        return None if data is None else unpack(spark, data)


class KafkaStore:
    """Last record of a topic's partition 0 under a fixed key, through Spark's Kafka connector (which the session must have)."""

    KEY = "temploom-catalog"

    def __init__(self, brokers: str, topic: str, timeout_ms: int = 10_000) -> None:
        self.brokers, self.topic, self.timeout_ms = brokers, topic, timeout_ms

    def save(self, catalog: DataFrame, opts: MinerOptions, counter: int) -> None:
        data = pack(catalog, _meta(opts, counter))
        row = catalog.sparkSession.createDataFrame([(self.KEY, bytearray(data), 0)], "key string, value binary, partition int")
        row.write.format("kafka").option("kafka.bootstrap.servers", self.brokers).option("topic", self.topic).option("kafka.request.timeout.ms", self.timeout_ms).save()

    def load(self, spark: SparkSession) -> tuple[DataFrame, dict] | None:
        df = spark.read.format("kafka").option("kafka.bootstrap.servers", self.brokers).option("assign", json.dumps({self.topic: [0]})).option("kafkaConsumer.pollTimeoutMs", self.timeout_ms).load()
        last = df.orderBy(df.offset.desc()).select("value").head()
        return None if last is None else unpack(spark, bytes(last.value))

