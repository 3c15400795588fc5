"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


POST = _struct(
    id=LongType(),
    user=_struct(id=LongType(), id_str=StringType(), location=StringType()),
    text=StringType(),
    entities=_struct(user_mentions=ArrayType(_struct(id=LongType(), id_str=StringType())), hashtags=ArrayType(_struct(text=StringType()))),
    geo=_struct(coordinates=ArrayType(DoubleType())),
    coordinates=_struct(type=StringType(), coordinates=ArrayType(DoubleType())),
    place=_struct(place_type=StringType(), full_name=StringType(), country=StringType()),
    retweeted_status=StringType(),
    created_at=StringType(),
)
USER = _struct(user_id=StringType(), posts=ArrayType(POST))
FLAT_POST = _struct(
    user_id=LongType(), id=LongType(), text=StringType(), location=StringType(), lat=DoubleType(), lon=DoubleType(),
    mentions=ArrayType(LongType()), hashtags=ArrayType(StringType()), is_retweet=BooleanType(), place=StringType(),
)
EDGE = _struct(src=LongType(), dst=LongType(), weight=LongType())
LOCATION = _struct(user_id=LongType(), lat=DoubleType(), lon=DoubleType())
GAZETTEER = _struct(seq=LongType(), city=StringType(), region=StringType(), country=StringType(), lat=DoubleType(), lon=DoubleType())
GOLD = _struct(post_id=LongType(), user_id=LongType(), lat=DoubleType(), lon=DoubleType(), fold=IntegerType())
PREDICTION = _struct(post_id=LongType(), lat=DoubleType(), lon=DoubleType())
