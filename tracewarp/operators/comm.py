"""Messages between processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import histogram

SENDS = ("MpiSend", "MpiIsend")
RECEIVES = ("MpiRecv", "MpiIrecv")


def _attribute(events: DataFrame, name: str) -> Column:
    if name in events.columns:
        return F.col(name).cast("bigint")
    if "attributes" not in events.columns:
        raise ValueError("message operators need attributes, or receiver and msg_length columns")
    return F.get_json_object("attributes", f"$.{name}").cast("bigint")


def messages(events: DataFrame, names=SENDS) -> DataFrame:
    """(ts_ns, process, receiver, msg_length) of the message events."""
    chosen = events.filter(F.col("name").isin(list(names)))
    return chosen.select("ts_ns", "process", _attribute(events, "receiver").alias("receiver"), _attribute(events, "msg_length").alias("msg_length"))


def _amount(output: str) -> Column:
    if output not in ("size", "count"):
        raise ValueError("output is 'size' or 'count'")
    return F.sum("msg_length") if output == "size" else F.count(F.lit(1))


def comm_matrix(events: DataFrame, output: str = "size", dense: bool = True) -> DataFrame:
    """(sender, receiver, volume) for every pair of processes, 0 where nothing was sent.

    ``dense=False`` gives only the pairs that talked, for very many processes.
    """
    amount = _amount(output)
    sent = messages(events).groupBy(F.col("process").alias("sender"), "receiver").agg(F.coalesce(amount, F.lit(0)).cast("double").alias("volume"))
    if not dense:
        return sent
    ranks = events.select("process").distinct()
    grid = ranks.select(F.col("process").alias("sender")).crossJoin(ranks.select(F.col("process").cast("bigint").alias("receiver")))
    return grid.join(sent, ["sender", "receiver"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def comm_by_process(events: DataFrame, output: str = "size") -> DataFrame:
    """(process, sent, received) for every process."""
    pairs = comm_matrix(events, output, dense=False)
    sides = F.array(
        F.struct(F.col("sender").cast("bigint").alias("process"), F.col("volume").alias("sent"), F.lit(0.0).alias("received")),
        F.struct(F.col("receiver").alias("process"), F.lit(0.0).alias("sent"), F.col("volume").alias("received")),
    )
    sums = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("process").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
    ranks = events.select(F.col("process").cast("bigint").alias("process")).distinct()
    return ranks.join(sums, "process", "left").na.fill(0.0)


def message_histogram(events: DataFrame, bins=20, **options) -> DataFrame:
    """Histogram of the sizes of sends."""
    return histogram(messages(events).filter("msg_length IS NOT NULL"), "msg_length", bins, options.get("range"), density=options.get("density", False))


def comm_over_time(events: DataFrame, output: str = "size", message_type: str = "send", bins=50, **options) -> DataFrame:
    """Bytes or messages over the whole trace's time; any type but ``send`` means receives."""
    _amount(output)
    chosen = messages(events, SENDS if message_type == "send" else RECEIVES)
    span = options.get("range")
    if span is None:
        low, high = events.agg(F.min("ts_ns"), F.max("ts_ns")).first()
        span = (0, 1) if low is None else (low, high)
    return histogram(chosen, "ts_ns", bins, span, weight="msg_length" if output == "size" else None, density=options.get("density", False))
