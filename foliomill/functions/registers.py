"""Registers and bit fields: parsing, masks, encoding, exports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import bound, escape, strip


def ident(c: Column, upper: bool = True) -> Column:
    """A C identifier."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9_]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    s = bound(s, lambda s: F.when(s == "", "X").when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s))
    return F.upper(s) if upper else s


def bits(c: Column) -> Column:
    """``lo, width`` of '7', '7:0' or '5-3'; null otherwise."""
    pair = r"^(\d+)[:\-–](\d+)$"
    made = lambda lo, width: F.struct(lo.cast("long").alias("lo"), width.cast("long").alias("width"))

    def read(s: Column) -> Column:
        a, b = (F.regexp_extract(s, pair, k).try_cast("long") for k in (1, 2))
        return F.when(s.rlike(pair), made(F.least(a, b), F.abs(a - b) + 1)).when(s.rlike(r"^\d+$"), made(s.try_cast("long"), F.lit(1)))

    return bound(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")), read)


def address(c: Column) -> Column:
    """0x... in upper case from 0x..., ...h or decimal, tried in that order; null otherwise."""
    read = lambda s: (
        F.when(s.rlike("^0[xX][0-9A-Fa-f]+$"), F.concat(F.lit("0x"), F.upper(F.regexp_replace(s, "^0[xX]", ""))))
        .when(s.rlike("^[0-9A-Fa-f]+[hH]$"), F.concat(F.lit("0x"), F.upper(F.regexp_replace(s, "[hH]$", ""))))
        .when(s.rlike("^[0-9]+$"), F.concat(F.lit("0x"), F.hex(s.try_cast("long"))))
    )
    return bound(strip(F.coalesce(c, F.lit(""))), read)


def mask(width: Column) -> Column:
    """A field's mask in hexadecimal, for widths below 63."""
    return F.concat(F.lit("0x"), F.hex(F.pow(F.lit(2.0), width).cast("long") - 1))


def field_mask(width: Column) -> Column:
    return F.when(width >= 32, F.lit(4294967295)).otherwise(F.pow(F.lit(2.0), width).cast("long") - 1)


def decode(value: Column, lo: Column, width: Column) -> Column:
    """A field of an unsigned 32-bit value."""
    v = value.cast("long").bitwiseAND(4294967295)
    return F.floor(v / F.pow(F.lit(2.0), lo)).cast("long").bitwiseAND(field_mask(width))


def encode(fields: Column) -> Column:
    """Unsigned 32-bit value of an array of ``lo, width, value``."""
    add = lambda acc, f: acc + f["value"].cast("long").bitwiseAND(field_mask(f["width"])) * F.pow(F.lit(2.0), f["lo"]).cast("long")
    return F.aggregate(fields, F.lit(0).cast("long"), add).bitwiseAND(4294967295)


def calculator_width(fields: Column) -> Column:
    """8, 16 or 32 bits, by the highest bit of ``lo, width`` entries."""
    top = F.array_max(F.transform(fields, lambda f: f["lo"] + f["width"] - 1))
    return F.when(top < 8, 8).when(top < 16, 16).otherwise(32)


def hex_text(value: Column, width: Column) -> Column:
    h = F.hex(value)
    return F.concat(F.lit("0x"), F.lpad(h, F.greatest(F.length(h), (width / 4).cast("int")), F.lit("0")))


def binary_text(value: Column, width: Column) -> Column:
    b = F.bin(value)
    return F.regexp_replace(F.lpad(b, F.greatest(F.length(b), width), F.lit("0")), "(.{4})(?=.)", "$1 ")


def header_lines(reg: Column) -> Column:
    """Lines of a C header for a register."""
    said = F.struct(ident(reg["name"]).alias("name"), address(reg["address"]).alias("addr"), strip(F.coalesce(reg["description"], F.lit(""))).alias("about"))
    return bound(said, lambda x: _header_lines(reg["fields"], x["name"], x["addr"], x["about"]))


def _header_lines(fields: Column, name: Column, addr: Column, about: Column) -> Column:
    title = F.concat(F.lit("/* "), name, F.when(about == "", "").otherwise(F.concat(F.lit(" — "), about)), F.lit(" */"))
    at = F.when(
        addr.isNotNull(),
        F.array(
            F.concat(F.lit("#define "), name, F.lit("_ADDR        ("), addr, F.lit("u)")),
            F.concat(F.lit("#define "), name, F.lit("            (*(volatile uint32_t *)"), addr, F.lit("u)")),
        ),
    ).otherwise(F.array().cast("array<string>"))

    def field(f: Column) -> Column:
        b, full = f["b"], f["full"]
        return F.array(
            F.concat(F.lit("#define "), full, F.lit("_Pos    ("), b["lo"].cast("string"), F.lit("u)")),
            F.concat(F.lit("#define "), full, F.lit("_Msk    ("), mask(b["width"]), F.lit("u << "), full, F.lit("_Pos)")),
        )

    fields = F.coalesce(fields, F.array().cast("array<struct<bits:string,name:string,access:string,description:string>>"))
    placed = F.transform(fields, lambda f: F.struct(bits(f["bits"]).alias("b"), F.concat(name, F.lit("_"), ident(f["name"])).alias("full")))
    known = F.filter(placed, lambda f: f["b"].isNotNull())
    return F.concat(F.array(title), at, F.flatten(F.transform(known, field)), F.array(F.lit("")))


def header_frame(device: Column, source: Column) -> tuple[Column, Column]:
    """Lines of a C header before and after its groups."""
    guard = F.concat(ident(device), F.lit("_H"))
    head = F.array(
        F.concat(F.lit("/* "), device, F.lit(" register definitions, generated from "), source, F.lit(".")),
        *map(F.lit, K.HEADER_WARNING),
        F.concat(F.lit("#ifndef "), guard), F.concat(F.lit("#define "), guard),
        F.lit(""), F.lit("#include <stdint.h>"), F.lit(""),
    )
    return head, F.array(F.concat(F.lit("#endif /* "), guard, F.lit(" */")))


def header_title(title: Column) -> Column:
    return F.concat(F.lit("/* ===== "), F.coalesce(title, F.lit("")), F.lit(" ===== */"))


def c_header(groups: Column, device: Column, source: Column) -> Column:
    """C header of an array of ``title, registers``; empty if there is no register."""
    head, tail = header_frame(device, source)
    body = F.flatten(F.transform(groups, lambda g: F.concat(F.array(header_title(g["title"])), F.flatten(F.transform(g["registers"], header_lines)))))
    some = F.exists(groups, lambda g: F.size(g["registers"]) > 0)
    return F.when(some, F.concat(F.array_join(F.concat(head, body, tail), "\n"), F.lit("\n"))).otherwise("")


def access_out(c: Column) -> Column:
    """Access as CMSIS-SVD writes it."""
    return bound(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")), lambda a: F.when(a.contains("r/w") | a.contains("rw"), "read-write").when(a.isin("r", "ro", "read"), "read-only").when(a.isin("w", "wo", "write"), "write-only").otherwise(""))


def access_in(c: Column) -> Column:
    """Access as shown, from CMSIS-SVD."""
    a = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(a.isin("read-write", "read-writeonce"), "R/W").when(a == "read-only", "R").when(a.isin("write-only", "writeonce"), "W").otherwise("")


def svd_int(c: Column, default: int = 0) -> Column:
    """0x..., #binary, 0o.../0b... and decimal; a decimal with a leading zero gives the default."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    based = lambda prefix, base: F.conv(F.regexp_replace(s, prefix, ""), base, 10).try_cast("long")
    value = (
        F.when(s.rlike("^0x[0-9a-f]+$"), based("^0x", 16)).when(s.rlike("^#[01]+$"), based("^#", 2))
        .when(s.rlike("^0b[01]+$"), based("^0b", 2)).when(s.rlike("^0o[0-7]+$"), based("^0o", 8))
        .when(s.rlike("^(0+|[1-9][0-9]*)$"), s.try_cast("long"))
    )
    return F.coalesce(value, F.lit(default).cast("long"))


def svd_bits(f: Column) -> Column:
    """``lo, width`` of a field element: bit offset, else bit range, else lsb and msb; else null."""
    made = lambda lo, width: F.struct(lo.cast("long").alias("lo"), width.cast("long").alias("width"))
    rng = r"^\[?\s*(\d+)\s*:\s*(\d+)\s*\]?"
    hi, lo = (F.regexp_extract(f["bitRange"], rng, k).try_cast("long") for k in (1, 2))
    a, b = svd_int(f["lsb"]), svd_int(f["msb"])
    return (
        F.when(f["bitOffset"].isNotNull(), made(svd_int(f["bitOffset"]), svd_int(F.coalesce(F.nullif(f["bitWidth"], F.lit("")), F.lit("1")), 1)))
        .when(f["bitRange"].rlike(rng), made(F.least(hi, lo), F.abs(hi - lo) + 1))
        .when(f["lsb"].isNotNull() & f["msb"].isNotNull(), made(F.least(a, b), F.abs(b - a) + 1))
    )


def svd_register_xml(r: Column) -> Column:
    """A register element; null without an address."""
    def field(f: Column) -> Column:
        b, acc = f["b"], f["acc"]
        return F.concat(
            F.lit("          <field><name>"), f["name"], F.lit("</name><bitOffset>"), b["lo"].cast("string"),
            F.lit("</bitOffset><bitWidth>"), b["width"].cast("string"), F.lit("</bitWidth>"),
            F.when(acc == "", "").otherwise(F.concat(F.lit("<access>"), acc, F.lit("</access>"))), F.lit("</field>"),
        )

    placed = F.transform(r["fields"], lambda f: F.struct(bits(f["bits"]).alias("b"), escape(ident(f["name"], upper=False)).alias("name"), access_out(f["access"]).alias("acc")))
    fields = F.transform(F.filter(placed, lambda f: f["b"].isNotNull()), field)
    several = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("\n        <fields>\n"), F.array_join(x, "\n"), F.lit("\n        </fields>\n      "))).otherwise("")
    return bound(address(r["address"]), lambda addr: F.when(addr.isNotNull(), F.concat(
        F.lit("        <register><name>"), escape(ident(r["name"], upper=False)), F.lit("</name><addressOffset>"), addr,
        F.lit("</addressOffset><size>32</size>"), bound(fields, several), F.lit("</register>"),
    )))


def svd_frame(device: Column, source: Column) -> tuple[Column, Column]:
    """A CMSIS-SVD document before and after its peripherals, without the newlines between."""
    name = escape(ident(device, upper=False))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!-- Generated from '), escape(source),
        F.lit(f". {K.SVD_WARNING} -->\n{K.SVD_DEVICE}\n  <name>"),
        name, F.lit("</name>\n  <version>1.0</version>\n  <description>"), name,
        F.lit(" (generated)</description>\n  <addressUnitBits>8</addressUnitBits>\n  <width>32</width>\n  <size>32</size>\n  <peripherals>"),
    )
    return head, F.lit("  </peripherals>\n</device>")


PERIPHERAL_TAIL = "      </registers>\n    </peripheral>"


def peripheral_head(title: Column) -> Column:
    return F.concat(
        F.lit("    <peripheral>\n      <name>"), escape(ident(F.coalesce(F.nullif(title, F.lit("")), F.lit("PERIPH")), upper=False)),
        F.lit("</name>\n      <baseAddress>0x0</baseAddress>\n      <registers>"),
    )


def svd_document(groups: Column, device: Column, source: Column) -> Column:
    """CMSIS-SVD of an array of ``title, registers``; null without any addressed register."""
    def peripheral(g: Column) -> Column:
        regs = F.filter(F.transform(g["registers"], svd_register_xml), lambda x: x.isNotNull())
        return F.when(F.size(regs) > 0, F.concat_ws("\n", peripheral_head(g["title"]), F.array_join(regs, "\n"), F.lit(PERIPHERAL_TAIL)))

    made = F.filter(F.transform(groups, peripheral), lambda x: x.isNotNull())
    head, tail = svd_frame(device, source)
    return F.when(F.size(made) > 0, F.concat(head, F.lit("\n"), F.array_join(made, "\n"), F.lit("\n"), tail, F.lit("\n")))
