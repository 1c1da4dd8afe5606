"""Bounded reference traversal and per-function features over edge tables.

code: (frm_func, to[, frm_site]); data: (frm_func, to). A path function is -1 where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_literal, escape_literal
from .dedup import append_new, first_wins, two_key_first_wins

KEY = ["func_addr", "string_addr", "path_func1", "path_func2", "path_func3"]
#: Addresses of a page by which references meet the functions that cover it.
PAGE = 4096


def in_range(ea: Column, low: Column, size: Column) -> Column:
    return (ea >= low) & (ea < low + size)


def hex_address(ea: Column) -> Column:
    """An address as reports write it."""
    return F.concat(F.lit("0x"), F.hex(ea))


def is_string_xref(is_data: Column, to: Column, length: Column, rdata: Column, idata: Column | None = None, idata_size: Column | None = None) -> Column:
    """A data reference to a non-empty string from ``.rdata`` on; with ``idata``, also outside the import section."""
    found = is_data & (length > 0) & ~(to < rdata)
    return found if idata is None else found & ~in_range(to, idata, idata_size)


def functions_around(refs: DataFrame, bounds: DataFrame, address: str = "to") -> DataFrame:
    """``refs`` with ``inside``, the start of the function that ``address`` lies in; references into no function are left out.

    ``bounds``: func_addr, func_end (exclusive); functions do not overlap. A function meets the references of the pages that it covers,
    so the containment is a test on an equi-join.
    """
    page = lambda c: F.floor(c / PAGE)
    covered = bounds.where("func_end > func_addr").select(
        F.col("func_addr").alias("inside"), F.col("func_end").alias("__end"), F.explode(F.sequence(page(F.col("func_addr")), page(F.col("func_end") - 1))).alias("__page")
    )
    met = refs.withColumn("__page", page(F.col(address))).join(covered, "__page")
    return met.where((F.col(address) >= F.col("inside")) & (F.col(address) < F.col("__end"))).drop("__page", "__end")


def _calls(pairs: DataFrame) -> DataFrame:
    """Distinct calls (f, g) of ``pairs``, with ``back``: g calls f too. A pair of functions meets once, whatever the direction."""
    lone = F.col("f").isNull()  # a call from no function gives paths of none
    met = pairs.where("g is not null").groupBy(F.least("f", "g").alias("low"), F.greatest("f", "g").alias("high"), lone.alias("lone"))
    met = met.agg(F.max(lone | (F.col("f") <= F.col("g"))).alias("up"), F.max(F.col("f") > F.col("g")).alias("down"))
    back = ~F.col("lone") & ((F.col("up") & F.col("down")) | (F.col("low") == F.col("high")))
    caller = F.when(~F.col("lone"), F.col("low"))
    ways = F.array(F.struct(caller.alias("f"), F.col("high").alias("g"), F.col("up").alias("is")), F.struct(F.col("high").alias("f"), F.col("low").alias("g"), F.col("down").alias("is")))
    return met.select(back.alias("back"), F.explode(ways).alias("way")).where("way.is").select("way.f", "way.g", "back")


def xref_paths(
    code: DataFrame, data: DataFrame, imports: DataFrame | None = None, bounds: DataFrame | None = None, attributes: DataFrame | None = None, functions: DataFrame | None = None
) -> DataFrame:
    """Strings reached from each function: by itself, one or two calls down, or one caller up.

    Fixed joins, no iteration. ``imports`` (func) are skipped as targets. With ``bounds`` (func_addr, func_end) a call that goes into
    a function's middle counts as a call of it, and its own target stands in the path; without, targets are functions'
    starts. Where a path is found downwards and upwards the downward one stays. ``attributes`` (string_addr, unique; any columns)
    meet the references, so that no join of theirs sees the paths; ``functions`` (func_addr, unique) limits the paths to theirs.
    """
    calls = code.select(F.col("frm_func").alias("f"), F.col("to").alias("g"))
    if imports is not None:
        calls = calls.join(imports.select(F.col("func").alias("g")), "g", "left_anti")
    # without bounds a call back gives the same paths downwards as the call upwards; with bounds, targets may differ from starts
    calls = functions_around(calls.distinct(), bounds, "g").withColumn("back", F.lit(False)) if bounds is not None else _calls(calls).withColumn("inside", F.col("g"))
    refs = data.select(F.col("frm_func").alias("owner"), F.col("to").alias("s")).distinct()
    more = []
    if attributes is not None:
        more = [c for c in attributes.columns if c != "string_addr"]
        refs = refs.join(attributes.select(F.col("string_addr").alias("s"), *more), "s", "left")
    of = (lambda df, func: df) if functions is None else (lambda df, func: df.join(functions.select(F.col("func_addr").alias(func)), func, "left_semi"))

    def rows(df: DataFrame, func: str, pf1, pf2, depth: int, upward: int) -> DataFrame:
        lit = lambda x: F.lit(-1).cast("bigint") if x is None else F.col(x).cast("bigint")
        return df.select(
            F.col(func).cast("bigint").alias("func_addr"), F.col("s").cast("bigint").alias("string_addr"), lit(pf1).alias("path_func1"), lit(pf2).alias("path_func2"),
            F.lit(-1).cast("bigint").alias("path_func3"), F.lit(depth).alias("ref_depth"), F.lit(upward).alias("is_upward"), *more,
        )

    own = rows(of(refs, "owner"), "owner", None, None, 0, 0)
    first = of(calls.select("f", "g", "inside"), "f")
    down1 = rows(first.join(refs, F.col("inside") == F.col("owner")), "f", "g", None, 1, 0)
    # the second call meets its strings before the first one, which multiplies
    second = calls.select(F.col("f").alias("middle"), F.col("g").alias("h"), F.col("inside").alias("deep")).join(refs, F.col("deep") == F.col("owner")).select("middle", "h", "s", *more)
    down2 = rows(first.join(second, F.col("inside") == F.col("middle")), "f", "g", "h", 2, 0)
    # callers refer to a function's start
    up = rows(of(calls.where("g = inside and not back"), "g").join(refs, F.col("f") == F.col("owner")), "g", "f", None, 1, 1)
    near = down1.unionByName(up)
    # depth 0 has no path function and depth 2 has two, so only the depth-1 branches can meet
    return own.unionByName(down2).unionByName(first_wins(near, KEY, ["is_upward"]).select(own.columns) if bounds is not None else near)


def func_features(funcs: DataFrame, code: DataFrame, data: DataFrame, instructions: DataFrame | None = None) -> DataFrame:
    """``funcs`` (func_addr) with the distinct referring sites, referred functions, strings, and instructions of each."""
    referrers = code.groupBy(F.col("to").alias("func_addr")).agg(F.countDistinct("frm_site").alias("nb_referrers"))
    referees = code.groupBy(F.col("frm_func").alias("func_addr")).agg(F.countDistinct("to").alias("nb_referees"))
    strings = data.groupBy(F.col("frm_func").alias("func_addr")).agg(F.countDistinct("to").alias("nb_strings"))
    out = funcs.select("func_addr")
    parts = [referrers, strings, referees]
    if instructions is not None:
        parts.append(instructions.groupBy("func_addr").agg(F.count("*").alias("instructions")))
    for part in parts:
        out = out.join(part, "func_addr", "left")
    return out.fillna(0)


def export_strings(raw: DataFrame) -> DataFrame:
    """(address, literal) of ``raw`` (seq, address, bytes): decoded, escaped, and unique by address and by literal, the first in ``seq`` first.

    A row is kept unless an earlier kept row has its address or its literal.
    """
    rows = raw.select("address", escape_literal(decode_literal(F.col("bytes"))).alias("literal"), "seq").where("literal is not null")
    return two_key_first_wins(rows, "address", "literal", "seq").select("address", "literal")


def missing_strings(paths: DataFrame, strings: DataFrame) -> DataFrame:
    """String addresses that paths name and ``strings`` lacks, with their path counts."""
    return paths.groupBy("string_addr").count().join(strings, F.col("string_addr") == F.col("address"), "left_anti")


def export_missing_strings(paths: DataFrame, strings: DataFrame, raw: DataFrame) -> DataFrame:
    """New rows (address, literal) for ``strings``: what ``raw`` (seq, address, bytes) has of the missing ones, decoded and escaped.

    Strings that decode to nothing, and literals that are there already, stay missing.
    """
    wanted = missing_strings(paths, strings).select(F.col("string_addr").alias("address"))
    rows = raw.join(wanted, "address", "left_semi").select("address", escape_literal(decode_literal(F.col("bytes"))).alias("literal"), "seq")
    return append_new(strings, rows.where("literal is not null"), ["literal"], ["seq"]).select("address", "literal")
