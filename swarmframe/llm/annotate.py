"""Add columns to documents by a function over slices of their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from swarmframe.llm.textbuf import slices


def annotate(
    docs: DataFrame,
    function: Callable[[pa.RecordBatch], dict[str, object]],
    fields: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    finish: Callable[[list[dict[str, object]]], None] | None = None,
) -> DataFrame:
    """``keep`` of docs, then the columns that ``function`` makes of each slice.

    function: gets a RecordBatch of ``keep`` and ``text`` with about a megabyte of
    text, returns arrays by field name.  fields: their names and types as DDL.
    finish: may complete what the slices of one Arrow batch have made, all together.
    Other columns of docs are not read, so their names may clash with anything.
    """
    added = T.StructType.fromDDL(fields)
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, *added.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in added.fields]
    wanted = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(slices(batch, text))
            results = map(function, parts)
            if finish:
                results = list(results)
                finish(results)
            for part, made in zip(parts, results, strict=True):
                columns = [part.column(c).cast(arrow.field(i).type) for i, c in enumerate(keep)]
                columns += [pa.array(made[n], type=arrow.field(len(keep) + i).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*wanted).mapInArrow(run, schema)
