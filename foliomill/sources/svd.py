"""CMSIS-SVD files as register groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.registers import access_in, svd_bits, svd_int
from ..functions.text import collapse

_FIELD = "name:string,bitRange:string,bitOffset:string,bitWidth:string,lsb:string,msb:string,access:string,description:string"
PERIPHERAL = (
    "name string, baseAddress string, registers struct<register:array<struct<name:string,addressOffset:string,description:string,"
    f"fields:struct<field:array<struct<{_FIELD}>>>>>>"
)


def read_svd(spark: SparkSession, path: str) -> DataFrame:
    """``title, registers`` of each peripheral with registers, wherever it stands in the file."""
    raw = spark.read.format("xml").option("rowTag", "peripheral").schema(PERIPHERAL).load(path)
    return register_groups(raw)


def registers_of(base: Column, registers: Column) -> Column:
    """Registers of one peripheral; fields without a bit range are left out."""
    text = lambda c: collapse(F.coalesce(c, F.lit("")))
    none = F.array().cast(f"array<struct<{_FIELD}>>")

    def field(f: Column) -> Column:
        b = svd_bits(f)
        top = (b["lo"] + b["width"] - 1).cast("string")
        spec = F.when(b["width"] == 1, b["lo"].cast("string")).otherwise(F.concat(top, F.lit(":"), b["lo"].cast("string")))
        return F.struct(spec.alias("bits"), text(f["name"]).alias("name"), access_in(f["access"]).alias("access"), text(f["description"]).alias("description"))

    return F.transform(
        registers,
        lambda r: F.struct(
            text(r["name"]).alias("name"), text(r["description"]).alias("description"),
            F.concat(F.lit("0x"), F.hex(svd_int(base) + svd_int(r["addressOffset"]))).alias("address"),
            F.transform(F.filter(F.coalesce(r["fields"]["field"], none), lambda f: svd_bits(f).isNotNull()), field).alias("fields"),
        ),
    )


def register_groups(raw: DataFrame) -> DataFrame:
    regs = raw.filter("size(registers.register) > 0")
    return regs.select(collapse(F.coalesce("name", F.lit(""))).alias("title"), registers_of(F.col("baseAddress"), F.col("registers.register")).alias("registers"))
