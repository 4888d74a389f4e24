"""Settings from a properties file, and the session they describe."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass
class Config:
    """Known settings; any ``spark.*`` line goes to the session as it is."""

    spark_master: str = "local[*]"
    parallelism: int = 0
    kryo: bool = False
    dependency_jar: str = ""
    stores: str = ""
    statistics_file: str = ""
    advisor_randomness: float = 0.1
    spark: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Config:
        """``key=value`` lines; # starts a comment; unknown keys raise.

        Addresses of store servers (``*_host``, ``*_port``, ``hbase_trigger_*``) are accepted and have no use here, as stores are folders.
        """
        out, kinds = cls(), {f.name: f.type for f in fields(cls)}
        for line in Path(path).read_text().splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition("="))
            if key.startswith("spark."):
                out.spark[key] = value
            elif key in kinds and key != "spark":
                cast = {"int": int, "float": float, "bool": lambda v: v.lower() == "true"}.get(kinds[key], str)
                setattr(out, key, cast(value))
            elif not key.endswith(("_host", "_port")) and not key.startswith("hbase_trigger_"):
                raise ValueError(f"unknown setting {key}")
        return out

    def session(self, name: str = "loomql") -> SparkSession:
        builder = SparkSession.builder.master(self.spark_master).appName(name).config("spark.sql.session.timeZone", "UTC")
        if self.parallelism:
            builder = builder.config("spark.sql.shuffle.partitions", str(self.parallelism))
        if self.kryo:
            builder = builder.config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        if self.dependency_jar:
            builder = builder.config("spark.jars", self.dependency_jar)
        if self.stores:
            builder = builder.config("spark.loomql.stores", self.stores)
        for key, value in self.spark.items():
            builder = builder.config(key, value)
        return builder.getOrCreate()
