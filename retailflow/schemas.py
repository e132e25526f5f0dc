"""Record schemas, bound by field name.

Amounts are doubles at the record boundary (JSON, document index) and whole cents
inside every computation, see functions.scalars.to_cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(),
          "timestamp": T.TimestampType()}


def _schema(fields: str) -> T.StructType:
    """"name type, name type" to a schema (usable before a session exists)."""
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


STARTUP_LOG = T.StructType(
    [T.StructField("common", _schema("mid string, uid string, ar string, ch string, vc string"))]
    + _schema("start string, ts bigint").fields
)

DAU_INFO = _schema(
    "mid string, uid string, ar string, ch string, vc string, dt string, hr string, mi string, ts bigint"
)

ORDER_INFO = _schema(
    "id bigint, province_id bigint, order_status string, user_id bigint, "
    "final_total_amount double, benefit_reduce_amount double, original_total_amount double, feight_fee double, "
    "expire_time string, create_time string, operate_time string, create_date string, create_hour string, "
    "if_first_order string, province_name string, province_area_code string, province_iso_code string, "
    "province_iso_3166_2 string, user_age_group string, user_gender string"
)

ORDER_DETAIL = _schema(
    "id bigint, order_id bigint, sku_id bigint, order_price double, sku_num bigint, sku_name string, "
    "create_time string, spu_id bigint, tm_id bigint, category3_id bigint, "
    "spu_name string, tm_name string, category3_name string"
)

ORDER_WIDE = _schema(
    "order_detail_id bigint, order_id bigint, order_status string, create_time string, user_id bigint, "
    "sku_id bigint, sku_price double, sku_num bigint, sku_name string, benefit_reduce_amount double, "
    "original_total_amount double, feight_fee double, final_total_amount double, final_detail_amount double, "
    "if_first_order string, province_name string, province_area_code string, user_age_group string, "
    "user_gender string, dt string, spu_id bigint, tm_id bigint, category3_id bigint, "
    "spu_name string, tm_name string, category3_name string"
)

# The order document of the search index: 20 typed fields, the day is a date.
ORDER_DOCUMENT = _schema(
    "id bigint, province_id bigint, order_status string, user_id bigint, final_total_amount double, "
    "benefit_reduce_amount double, original_total_amount double, feight_fee double, expire_time string, "
    "create_time string, create_date date, create_hour string, if_first_order string, province_name string, "
    "province_area_code string, province_iso_code string, province_iso_3166_2 string, "
    "user_age_group string, user_gender string, operate_time string"
)

PROVINCE = _schema("id string, name string, area_code string, iso_code string, iso_3166_2 string")
USER_INFO = _schema(
    "id string, user_level string, birthday string, gender string, age_group string, gender_name string"
)
SKU_INFO = _schema(
    "id string, spu_id string, price string, sku_name string, tm_id string, category3_id string, "
    "create_time string, category3_name string, spu_name string, tm_name string"
)
SPU_INFO = _schema("id string, spu_name string")
TRADEMARK = _schema("tm_id string, tm_name string")
CATEGORY3 = _schema("id string, name string, category2_id string")
# `order_id` is the order that was the user's first; unknown for users taken over from elsewhere.
USER_STATE = _schema("user_id string, if_consumed string, order_id bigint, create_time string")

# One message of a topic in the file backend. `producer`, `batch_id` and `seq` are its position,
# `arrived` the time at which it was written.
TOPIC_MESSAGE = _schema("key string, value string, seq bigint, arrived timestamp, producer string, batch_id bigint")


def decode(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON text to typed columns. Unknown fields are ignored; text that is not JSON of this
    shape ends up whole in `_corrupt_record`, so one bad message does not end a stream."""
    with_bad = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    rest = [c for c in messages.columns if c != value]
    parsed = F.from_json(F.col(value), with_bad, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return messages.select(*rest, parsed.alias("_record")).select(*rest, "_record.*")


def split_corrupt(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of a decoded frame."""
    good = decoded.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = decoded.filter(F.col("_corrupt_record").isNotNull())
    return good, bad


def encode(key: str | None = None, columns: list[str] | None = None) -> list[Column]:
    """(key, value) of a record: JSON with the declared field names, nulls left out."""
    body = F.to_json(F.struct(*columns) if columns else F.struct("*"))
    return [F.col(key).cast("string").alias("key") if key else F.lit(None).cast("string").alias("key"),
            body.alias("value")]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared fields, in declared order and type; a missing one becomes NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
