"""What is checked about a record as it arrives, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of a whole run: the raw one and five methods by four quality factors. In single mode there is one.
WHOLE_RUN = 21
#: Bytes of a raw frame, and of the longest compressed one.
RAW_BYTES, MOST_BYTES = 230_400, 687_600
#: Modes of a record on the wire.
RAW, JPEG = 1, 2


def expected_records(single: Column) -> Column:
    return F.when(single, 1).otherwise(WHOLE_RUN)


def size_status(raw: Column, size: Column) -> Column:
    """The status of a payload of the wrong size; null if the size is right."""
    return F.when(raw & (size != RAW_BYTES), "RAW_SIZE_FAIL").when(~raw & ((size <= 0) | (size > MOST_BYTES)), "JPEG_SIZE_FAIL")


def decodes(payload: Column) -> Column:
    """Whether the bytes of a block are run lengths: two bytes of the first value, then a run of zeros and two bytes of a value each, to an end (three zeros) or to place 63. A run past the block or a missing end isn't one."""
    size = F.octet_length(payload)
    byte = lambda at: F.conv(F.hex(F.substr(payload, at, F.lit(1))), 16, 10).cast("int")
    steps = F.sequence(F.lit(0), F.floor((size - 2) / 3).cast("int") - 1)

    def step(place: Column, i: Column) -> Column:
        run, low, high = (byte(i * 3 + k) for k in (3, 4, 5))
        end = (run == 0) & (low == 0) & (high == 0)
        # places from 0; 100 is a good end, 200 a bad one
        return F.when(place >= 63, F.lit(200)).when(end, F.lit(100)).when(place + run + 1 > 63, F.lit(200)).otherwise(place + run + 1)

    last = F.aggregate(steps, F.lit(0), step)
    return F.coalesce((size >= 5) & ((size - 2) % 3 == 0) & last.isin(63, 100), F.lit(False))


def processed(records: DataFrame) -> DataFrame:
    """records (mode_type, payload_len, crc32 of the header, payload) with status: the first check that fails, else OK for a raw record and DECODED for a compressed one."""
    raw, jpeg = F.col("mode_type") == RAW, F.col("mode_type") == JPEG
    status = F.when(F.crc32("payload") != F.col("crc32"), "CRC_FAIL").when(~(raw | jpeg), "MODE_FAIL")
    return records.withColumn("status", F.coalesce(status, size_status(raw, F.col("payload_len")), F.when(jpeg & ~decodes(F.col("payload")), "DECODE_FAIL"), F.when(raw, "OK").otherwise("DECODED")))
