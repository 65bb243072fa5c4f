"""Explicit schemas of the engine's tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_s, _l, _i, _d, _b = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SYMBOLS = _table(id=_l, kind=_s, name=_s, path=_s, start_line=_i, end_line=_i, snippet=_s, search_blob=_s, embedding=T.ArrayType(T.FloatType()))
EDGES = _table(from_id=_l, to_id=_l, kind=_s, confidence=_d)
ALIASES = _table(file=_s, alias=_s, target_file=_s, target_member=_s)
IMPORT_EDGES = _table(from_file=_s, to_file=_s)
ENTRY_POINTS = _table(file=_s, func=_s, lang=_s, confidence=_s)
EVAL_QUERIES = _table(id=_s, axis=_i, query=_s, expected_paths=T.ArrayType(_s), negative=_b, subject=_s, subject_unindexed=_b)
EVAL_RESULTS = _table(id=_s, axis=_i, query=_s, negative=_b, top5=T.ArrayType(_s), precision_at_5=_d, notes=_s)
#: One row per syntactic capture: what stands where, and for imports and member calls what goes with it.
CAPTURES = _table(path=_s, role=_s, name=_s, qualifier=_s, source=_s, row=_i, byte=_i, variant=_i)
EDGE_KINDS = ("Calls", "Imports", "Implements", "Extends")


def assert_schema(df: DataFrame, want: T.StructType, exact: bool = False) -> DataFrame:
    """The frame itself, if it has the wanted columns with the wanted types (and no others, if exact)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in want.fields:
        if f.name not in have:
            raise ValueError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    if exact and (extra := set(have) - {f.name for f in want.fields}):
        raise ValueError(f"unexpected columns: {', '.join(sorted(extra))}")
    return df
