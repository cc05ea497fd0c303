"""Hand-written events: name the columns that matter, the rest are NULL."""

import datetime
from decimal import Decimal

from clickloom.schema import EVENT_SCHEMA


def at(day, hour=12):
    return datetime.datetime(2024, 1, day, hour, tzinfo=datetime.timezone.utc)


def events(spark, *rows):
    def value(row, name):
        given = row.get(name)
        return Decimal(given) if name == "price" and given is not None else given

    listed = [tuple(value(row, name) for name in EVENT_SCHEMA.names) for row in rows]
    return spark.createDataFrame(listed, EVENT_SCHEMA)


def one(frame):
    (row,) = frame.collect()
    return row.asDict()


def by(frame, key):
    return {row[key]: row.asDict() for row in frame.collect()}
