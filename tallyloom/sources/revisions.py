"""Revisions of a dataset as manifests: which files, with how many rows, a revision consists of.

``<root>/<name>/_revisions/<revision>.json`` lists the files of every split, in
reader order; the files lie below ``<root>/<name>/_data`` and are never changed,
so revisions share them. A manifest is written under a passing name and renamed:
a revision is there as a whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import names_in, read_text, write_text
from .reader_order import file_rows


def _manifests(root: str, name: str) -> str:
    return f"{root}/{name}/_revisions"


def revisions(spark: SparkSession, name: str, root: str = ".") -> list[str]:
    """The revisions a dataset has; none if it has no manifests."""
    return [file.removesuffix(".json") for file in names_in(spark, _manifests(root, name)) if file.endswith(".json")]


def manifest(spark: SparkSession, name: str, revision: str, root: str = ".") -> dict:
    """Splits of a revision: their schema and their files with row counts."""
    known = revisions(spark, name, root)
    if revision not in known:
        raise ValueError(f"{name} has no revision {revision!r}; there are {', '.join(known) or 'none'}")
    return json.loads(read_text(spark, f"{_manifests(root, name)}/{revision}.json"))


def _merged(old: StructType, new: StructType, split: str) -> StructType:
    """Columns of both; one of the same name has to have the same type."""
    fields = {field.name: field for field in old.fields}
    for field in new.fields:
        if field.name in fields and fields[field.name].dataType != field.dataType:
            raise ValueError(f"{field.name} changes its type in {split}")
        fields.setdefault(field.name, field)
    return StructType(list(fields.values()))


def commit_revision(
    spark: SparkSession,
    name: str,
    revision: str,
    rows: Mapping[str, DataFrame],
    root: str = ".",
    base: str | None = None,
    keep: bool = True,
    move: bool = False,
) -> dict:
    """Write new rows per split and name the result ``revision``.

    With ``base`` its splits are part of it as well: new rows come behind those
    of a split, or in their place unless ``keep``. Files of the base are shared,
    not copied. A revision that exists raises; ``move`` lets its name go on to
    the new files, as that of a branch does. Nothing is visible before the end.
    """
    home = f"{root}/{name}"
    splits = manifest(spark, name, base, root)["splits"] if base is not None else {}
    if not move and revision in revisions(spark, name, root):
        raise FileExistsError(f"{name} has a revision {revision!r} already")
    folder = f"_data/{uuid.uuid4().hex}"
    for split, df in rows.items():
        df.write.parquet(f"{home}/{folder}/{split}")
        stored = spark.read.schema(df.schema).parquet(f"{home}/{folder}/{split}")
        files = [
            {"file": f"{folder}/{split}/{unquote(path.rpartition('/')[2])}", "rows": count} for path, count in file_rows(stored)
        ]
        schema = stored.schema
        if keep and split in splits:
            files = splits[split]["files"] + files
            schema = _merged(StructType.fromJson(splits[split]["schema"]), schema, split)
        splits[split] = {"schema": schema.jsonValue(), "files": files}
    found = {"revision": revision, "base": base, "splits": splits}
    write_text(spark, f"{_manifests(root, name)}/{revision}.json", json.dumps(found), replace=move)
    return found


def read_revision(spark: SparkSession, name: str, split: str, revision: str = "main", root: str = ".") -> DataFrame:
    """One split of a revision; columns that came later are null in older files."""
    splits = manifest(spark, name, revision, root)["splits"]
    if split not in splits:
        raise ValueError(f"{revision} of {name} has no split {split!r}; there are {', '.join(splits)}")
    schema = StructType.fromJson(splits[split]["schema"])
    files = [f"{root}/{name}/{entry['file']}" for entry in splits[split]["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
