"""Waveform archives: XML packets of base64 samples, decoded to a row for each packet and signal, or each sample.

The XML reader splits files by packet, so packets of one archive are decoded by many tasks. Samples are unpacked
by numpy on Arrow batches: SQL has no cast from bytes to an array of integers.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Samples that mean no data, and bytes of a sample.
NO_DATA, WIDTHS = (-32768, -32767), {1: "<i1", 2: "<i2", 4: "<i4"}
#: Least spread (p95 - p05) of a live channel; pressures that can be, the share of them, and of their median.
SPREAD, PRESSURE, SHARE, MEDIAN = 10.0, (-20.0, 300.0), 0.95, (20.0, 150.0)

_KEPT = ["case", "file", "seq", "start", "signal", "hz"]
_SCHEMA = "_seq string, _datetime string, mg array<struct<_name string, m array<struct<_name string, _VALUE string>>>>"


def samples(wave: str | None, width: int, gain: float, offset: float) -> np.ndarray:
    """Scaled samples of base64 text; no data is NaN, a cut-off last sample is dropped, bad base64 gives none."""
    try:
        data = base64.b64decode("".join((wave or "").split()), validate=True)
    except (binascii.Error, ValueError):
        return np.empty(0)
    kind = np.dtype(WIDTHS.get(width, "<i2"))
    raw = np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind)
    return np.where(np.isin(raw, NO_DATA), np.nan, raw * gain + offset)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inputs = zip(*(batch[c].to_pylist() for c in ("wave", "width", "gain", "offset")), strict=True)
        values = pa.array([samples(w, int(b), g, o) for w, b, g, o in inputs], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in _KEPT], values], [*_KEPT, "values"])


def _entry(name: str) -> Column:
    """The value of a measure's entry, null if it has none."""
    return F.element_at(F.map_from_entries(F.expr("transform(array_distinct(transform(filter(m, x -> x._name is not null), x -> x._name)), n -> struct(n, filter(m, x -> x._name = n)[0]._VALUE))")), F.lit(name))


def read(spark: SparkSession, path: str, gains: dict[str, float] | None = None) -> DataFrame:
    """``case`` (a file's folder), ``file``, ``seq``, ``start``, ``signal``, ``hz`` and ``values`` of each packet and signal below ``path``.

    A gain comes from ``gains``, else the archive, else it is 1. Sample width is the archive's, else two bytes.
    """
    packets = spark.read.format("xml").option("rowTag", "cpc").schema(_SCHEMA).load(path)
    place = F.split("_metadata.file_path", "/")
    measures = packets.select(F.element_at(place, -2).alias("case"), F.element_at(place, -1).alias("file"), F.col("_seq").try_cast("long").alias("seq"), F.try_to_timestamp("_datetime").alias("start"), F.explode("mg").alias("g")).select("case", "file", "seq", "start", F.col("g._name").alias("signal"), F.col("g.m").alias("m"))
    told = measures.select("case", "file", "seq", "start", "signal", _entry("Wave").alias("wave"), *[_entry(n).try_cast("double").alias(n.lower()) for n in ("PointsBytes", "Gain", "Offset", "Hz")])
    own = F.create_map(*[F.lit(x) for pair in (gains or {}).items() for x in pair])[F.col("signal")] if gains else F.lit(None).cast("double")
    inputs = [F.coalesce("pointsbytes", F.lit(2.0)).alias("width"), F.coalesce(own, "gain", F.lit(1.0)).alias("gain"), F.coalesce("offset", F.lit(0.0)).alias("offset")]
    return told.select(*_KEPT, "wave", *inputs).mapInArrow(_decode, "case string, file string, seq long, start timestamp, signal string, hz double, values array<double>")


def timed(packets: DataFrame) -> DataFrame:
    """A row for each sample that is data: ``signal``, ``at`` (start plus place over rate) and ``value``. No rate, no rows."""
    each = packets.where("hz > 0 and start is not null").select("signal", "start", "hz", F.posexplode("values").alias("place", "value"))
    at = F.timestamp_micros((F.unix_micros("start") + F.round(F.col("place") * 1e6 / F.col("hz"))).cast("long"))
    return each.where(F.col("value").isNotNull() & ~F.isnan("value")).select("signal", at.alias("at"), "value")


def assembled(packets: DataFrame, keys: list[str], order: list[str], gap: float) -> DataFrame:
    """Packets of many files on one time axis for each of ``keys``: cut where they overlap, and dealt into sessions.

    ``packets`` has ``start``, ``hz`` and ``values``; ``order`` (say file and seq) decides between equal starts and, with the
    keys, names a packet. What begins first keeps its time: a packet loses its samples up to where earlier ones reach,
    and goes if that is all of them. A session ends where no sample comes for over ``gap`` seconds. Adds ``session``
    (from 1), ``at`` (of the first sample left) and ``lost`` (samples cut). Packets without a start or a rate over zero
    have no place: they come with a null session, whole. Places are found on rows without samples; samples are
    moved once, by packet, so a channel with many packets is no task of its own with its samples.
    """
    name = [*keys, *order]
    micros = F.unix_micros(F.col("start").cast("timestamp"))
    told = packets.where(F.col("start").isNotNull() & (F.col("hz") > 0) & (F.size("values") > 0)).select(*name, micros.alias("_from"), "hz", F.size("values").alias("_n"))
    step = 1e6 / F.col("hz")
    before = Window.partitionBy(*keys).orderBy("_from", *order)
    placed = told.withColumn("_to", (F.col("_from") + F.round(F.col("_n") * step)).cast("long")).withColumn("_reached", F.max("_to").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    over = F.greatest(F.coalesce("_reached", F.col("_from")) - F.col("_from"), F.lit(0))
    fresh = F.col("_reached").isNull() | (F.col("_from") - F.col("_reached") > gap * 1e6)
    placed = placed.withColumns({"lost": F.least(F.ceil(over / step - 1e-9), F.col("_n")).cast("int"), "session": F.sum(fresh.cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(name)], "lost", "session", F.timestamp_micros((F.col("_from") + F.round(F.col("lost") * step)).cast("long")).alias("at"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(name)]
    joined = packets.join(placed, reduce(lambda x, y: x & y, same), "left").select(*packets.columns, "session", "at", F.coalesce("lost", F.lit(0)).alias("lost"))
    left = joined.withColumn("values", F.when(F.col("lost") > 0, F.slice("values", F.col("lost") + 1, F.greatest(F.size("values") - F.col("lost"), F.lit(0)))).otherwise(F.col("values")))
    return left.where(F.col("session").isNull() | (F.size("values") > 0))


def sessions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``begin``, ``end``, ``samples`` (data or not) and ``lost`` of each session of ``assembled`` packets."""
    end = F.unix_micros("at") + F.round(F.size("values") * 1e6 / F.col("hz")).cast("long")
    placed = rows.where("session is not null").withColumn("_end", end)
    return placed.groupBy(*keys, "session").agg(F.min("at").alias("begin"), F.timestamp_micros(F.max("_end")).alias("end"), F.sum(F.size("values")).alias("samples"), F.sum("lost").alias("lost"))


def value_counts(packets: DataFrame, keys: list[str], bits: int | None = None) -> DataFrame:
    """How often each value occurs (``n``), null for no data: a state from which quantiles are read, and that adds up over parts.

    Values of one- and two-byte samples are at most 65,536, so the state is exact and small. Of wider samples,
    ``bits`` keeps so many significant bits of each value, which bounds the state and moves a quantile by half of the
    last. A task sums up a batch of packets before anything is sent.
    """
    kinds = [packets.schema[c] for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["values"]
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            value = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
            if bits:
                fraction, power = np.frexp(value)
                value = np.ldexp(np.round(np.ldexp(fraction, bits)), power - bits)
            own = pa.Table.from_batches([batch.select(keys)]).take(pa.array(np.repeat(np.arange(batch.num_rows), size)))
            table = own.append_column("value", pa.array(value, pa.float64(), from_pandas=True))
            yield from table.group_by([*keys, "value"]).aggregate([([], "count_all")]).rename_columns([*keys, "value", "n"]).cast(out).to_batches()

    schema = T.StructType([*kinds, T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())])
    out = to_arrow_schema(schema)
    return packets.select(*keys, "values").mapInArrow(run, schema).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``n`` values (data alone), ``whole`` with no data, ``low``, ``high``, ``q`` (an array, on a line between neighbours) and ``inside`` ``PRESSURE`` of ``value_counts``."""
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    rows = counts.withColumn("_data", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    rows = rows.withColumns({"_upto": F.sum("_data").over(upto), "_all": F.sum("_data").over(every)})
    at = lambda place: F.min(F.when((F.col("_upto") > place) & F.col("value").isNotNull(), F.col("value")))
    places = [F.lit(s) * (F.col("_all") - 1) for s in shares]
    ends = [x.alias(f"_{side}{i}") for i, p in enumerate(places) for side, x in (("lo", at(F.floor(p))), ("hi", at(F.ceil(p))))]
    low, high = PRESSURE
    good = F.sum(F.when(F.col("value").between(low, high), F.col("n")).otherwise(0))
    told = rows.groupBy(*keys).agg(F.sum("_data").alias("n"), F.sum("n").alias("whole"), F.min("value").alias("low"), F.max("value").alias("high"), good.alias("_good"), *ends)
    line = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (s * (F.col("n") - 1) - F.floor(s * (F.col("n") - 1))) for i, s in enumerate(shares)]
    return told.select(*keys, "n", "whole", "low", "high", F.array(*line).alias("q"), F.try_divide("_good", "n").alias("inside"))


def states_of(counts: DataFrame, keys: list[str], pressures: list[str] | None = None, name: str = "signal") -> DataFrame:
    """``keys``, ``n``, ``whole``, ``low``, ``median``, ``high`` and ``state`` of each channel of ``value_counts``: nodata, idle, implausible (pressures alone) or active."""
    stats = quantiles(counts, keys, (0.05, 0.5, 0.95))
    odd = F.col(name).isin(pressures or []) & ((F.col("inside") < SHARE) | ~F.col("q")[1].between(*MEDIAN))
    state = F.when(F.col("n") == 0, "nodata").when(F.col("q")[2] - F.col("q")[0] < SPREAD, "idle").when(odd, "implausible").otherwise("active")
    return stats.select(*keys, "n", "whole", "low", F.col("q")[1].alias("median"), "high", state.alias("state"))


def channel_states(packets: DataFrame, pressures: list[str] | None = None) -> DataFrame:
    """``signal``, ``n`` samples and ``state``: nodata, idle, implausible (pressures alone) or active. A signal without samples is nodata."""
    known = packets.select("signal").distinct()
    found = states_of(value_counts(packets, ["signal"]), ["signal"], pressures).select("signal", "n", "state")
    return known.join(found, "signal", "left").select("signal", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("state", F.lit("nodata")).alias("state"))


def summary(packets: DataFrame, keys: list[str], pressures: list[str] | None = None) -> DataFrame:
    """Coverage of each channel: ``hz`` (the greatest), ``packets``, ``seconds``, ``valid`` (share of data, 3 places), and what ``states_of`` tells."""
    told = packets.groupBy(*keys).agg(F.max("hz").alias("hz"), F.count("*").alias("packets"), F.sum(F.when(F.col("hz") > 0, F.size("values") / F.col("hz"))).alias("seconds"))
    found = states_of(value_counts(packets, keys), keys, pressures)
    rows = told.join(found, keys, "left")
    return rows.withColumns({"seconds": F.round(F.coalesce("seconds", F.lit(0.0)), 1), "valid": F.round(F.coalesce(F.try_divide("n", "whole"), F.lit(0.0)), 3), "state": F.coalesce("state", F.lit("nodata"))})
