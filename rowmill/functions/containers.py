"""Container files that are values of a binary column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowmill.plans.project import check_projection, project_paths
from rowmill.schema import Schema
from rowmill.sources.container import MAX_BLOCK, MAX_EXPANDED, PushReader
from rowmill.types import bare, struct_of


def ocf_decode(files: DataFrame, key: str, content: str, schema: str | Schema, *, columns: list[str] | None = None, projection: str | Schema | None = None, max_block: int = MAX_BLOCK, max_expanded: int = MAX_EXPANDED) -> DataFrame:
    """The rows of every file, with the key of the file before them; a null file has none.

    Rows are resolved to the schema; with columns or a projection, files must have been written with it, and only
    those fields are decoded. Blocks become Arrow batches one at a time.
    """
    schema = Schema.parse(schema)
    narrow = project_paths(schema, columns) if columns else check_projection(schema, Schema.parse(projection)) if projection else schema
    out = T.StructType([T.StructField(key, files.schema[key].dataType), *bare(struct_of(narrow)).fields])
    whole, asked = schema.self_contained().to_json(), Schema.parse(projection).self_contained().to_json() if projection else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = Schema.parse(whole) if not columns and not asked else None
        strict = Schema.parse(asked) if asked else None
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py()
                if data is None:
                    continue
                reader = PushReader(target, strict, columns, max_block, max_expanded)
                reader.feed(data)
                reader.close_input()
                while (rows := reader.columns()) is not None:
                    keys = pa.array([batch.column(0)[at].as_py()] * rows.num_rows, batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *rows.columns], names=[key, *rows.schema.names])

    return files.select(key, content).mapInArrow(run, out)
