"""Sources as table functions of SQL: what they return depends on their arguments, and they take tables.

    register(spark)
    spark.sql("select * from xlsx_rows(table(select path, content from binaryFile.`/books`) partition by (path))")
    spark.sql("select * from fragment_records(table(select * from binaryFile.`/maps`) partition by (path), 'causal_edges')")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _file_columns(files: AnalyzeArgument) -> None:
    if not files.isTable or not {"path", "content"} <= {f.name for f in files.dataType.fields}:
        raise ValueError("give a table with the columns path and content")


#: Types of a fragment's columns that aren't text.  An analysis has no session that could read DDL.
_ARGUMENTS = ArrayType(StructType().add("node", StringType()).add("role", StringType()).add("derivative_sign", StringType()))
_TYPES: dict[str, DataType] = {"exogenous": BooleanType(), "definitional": BooleanType(), "can_flip_sign": BooleanType(), "arguments": _ARGUMENTS}


@udtf
class XlsxRows:
    """(path, sheet, row, cells) of a table of workbooks (path, content); with names, the rows below each sheet's first under the columns of these names.

    ``xlsx_rows(table)`` or ``xlsx_rows(table, 'id', 'name', ...)``: a sheet
    without one of the names raises.
    """

    @staticmethod
    def analyze(files: AnalyzeArgument, *names: AnalyzeArgument) -> AnalyzeResult:
        _file_columns(files)
        wanted = [n.value for n in names]
        if any(not isinstance(w, str) for w in wanted):
            raise ValueError("the names of columns are constant strings")
        out = StructType().add("path", StringType()).add("sheet", IntegerType()).add("row", IntegerType())
        if not wanted:
            return AnalyzeResult(out.add("cells", MapType(StringType(), StringType())))
        for w in wanted:
            out.add(w, StringType())
        return AnalyzeResult(out)

    def eval(self, files: Row, *names: str) -> Iterator[tuple]:
        from signflow.sources.scans import workbook_rows

        letters: dict[int, list[str]] = {}
        for sheet, row, cells in workbook_rows(bytes(files["content"])):
            if not names:
                yield files["path"], sheet, row, cells
            elif sheet not in letters:
                at = {v: k for k, v in cells.items()}
                if lost := [n for n in names if n not in at]:
                    raise ValueError(f"{files['path']}: the sheet has no columns {lost}")
                letters[sheet] = [at[n] for n in names]
            else:
                yield files["path"], sheet, row, *[cells.get(k) for k in letters[sheet]]


@udtf
class FragmentRecords:
    """The records of one collection, such as ``nodes`` or ``causal_edges``, of a table of YAML fragments (path, content), with the path and their place in it."""

    @staticmethod
    def analyze(files: AnalyzeArgument, collection: AnalyzeArgument) -> AnalyzeResult:
        from signflow.sources.fragments import COLLECTIONS, columns_of

        _file_columns(files)
        if collection.value not in COLLECTIONS:
            raise ValueError(f"a fragment has the collections {sorted(COLLECTIONS)}")
        out = StructType().add("path", StringType()).add("place", IntegerType())
        for c in columns_of(COLLECTIONS[collection.value][0]):
            out.add(c, _TYPES.get(c, StringType()))
        return AnalyzeResult(out)

    def eval(self, files: Row, collection: str) -> Iterator[tuple]:
        from signflow.sources.fragments import COLLECTIONS, columns_of, parse_fragment

        content = files["content"]
        got = parse_fragment(files["path"], content if isinstance(content, str) else bytes(content).decode("utf-8"))
        columns = columns_of(COLLECTIONS[collection][0])
        for i, x in enumerate(got[collection]):
            yield files["path"], i, *[[tuple(a[k] for k in ("node", "role", "derivative_sign")) for a in x[c]] if c == "arguments" else x[c] for c in columns]


def register(spark: SparkSession) -> None:
    spark.udtf.register("xlsx_rows", XlsxRows)
    spark.udtf.register("fragment_records", FragmentRecords)
