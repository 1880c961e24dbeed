"""Deep merge of nested values: what a patch holds replaces, what it leaves null stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType


def merged(old: Column, new: Column, old_type: DataType, new_type: DataType) -> Column:
    """``new`` merged into ``old``: structs field by field and maps key by key, however deep; anything else is replaced unless null.

    Fields that only one side has are kept; those of the old side come first."""
    if isinstance(old_type, StructType) and isinstance(new_type, StructType):
        mine, theirs = {f.name: f.dataType for f in old_type}, {f.name: f.dataType for f in new_type}
        fields = [merged(old[n], new[n], t, theirs[n]).alias(n) if n in theirs else old[n].alias(n) for n, t in mine.items()]
        fields += [new[n].alias(n) for n in theirs if n not in mine]
        return F.when(old.isNotNull() | new.isNotNull(), F.struct(*fields))
    if isinstance(old_type, MapType) and isinstance(new_type, MapType):
        both = F.map_zip_with(old, new, lambda _, a, b: merged(a, b, old_type.valueType, new_type.valueType))
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)
    return F.coalesce(new, old)
