"""The listing schema and how any frame is brought to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

_TEXT, _NUMBER, _WHOLE, _LIST = T.StringType(), T.DoubleType(), T.IntegerType(), T.ArrayType(T.StringType())
_KINDS = {
    T.LongType(): "idx",
    _TEXT: "listing_id search_id title dev_name builder city district address zip group_id group_link building_type source coord_origin descr url",
    T.BooleanType(): "is_launch",
    _NUMBER: "lat lng price area price_m2 score",
    _WHOLE: "rooms baths parking",
    T.TimestampNTZType(): "collected_at",
    _LIST: "imputed dup_sources photos",
}
LISTING = T.StructType([T.StructField(name, kind) for kind, names in _KINDS.items() for name in names.split()])
COORD_ORIGINS = ("exact", "source_approximate", "district_centroid")
BUILDING_TYPES = ("tower", "probable_block", "undefined")
GROUP_LINKS = ("confirmed", "probable")
LEVELS = ("same_building", "same_place", "same_name")


def conform(df: DataFrame) -> DataFrame:
    """Columns of the schema in its order: absent ones null, others cast where they can be (else null), blank texts null."""
    out = []
    for f in LISTING:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.nullif(F.trim(F.col(f.name).cast("string")), F.lit("")).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return df.select(*out)


FIRST_OWN_ID = 1 << 62


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sources, each brought to the schema. Rows without idx get one: above all given ones, growing in the order of the rows.

    The result is written to the scratch folder once, so a row keeps its number whatever is computed from it later.
    """
    first, *rest = [conform(f) for f in frames]
    for f in rest:
        first = first.unionByName(f)
    own = F.lit(FIRST_OWN_ID) + F.monotonically_increasing_id()
    return written(first.withColumn("idx", F.coalesce("idx", own)), "sources")
