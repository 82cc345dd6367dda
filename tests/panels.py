"""Small bar tables for the tests, and brute force in pandas."""

import numpy as np
import pandas as pd

from seqcast.config import Settings
from seqcast.operators.split import split_name
from pyspark.sql import functions as F

FEATURES = ("Open", "High", "Low", "Close", "Volume")


def bars(spark, lengths, every=None, seed=0, start="2020-01-01"):
    """A frame with ``lengths[symbol]`` bars each, on every ``every[symbol]``-th day."""
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, n in lengths.items():
        days = pd.date_range(start, periods=n, freq=f"{(every or {}).get(symbol, 1)}D")
        parts.append(pd.DataFrame({"Symbol": symbol, "Date": days,
                                   **{c: rng.random(n) * 100 for c in FEATURES}}))
    pdf = pd.concat(parts, ignore_index=True)
    text = pdf.assign(Date=pdf.Date.dt.strftime("%Y-%m-%d %H:%M:%S"))
    return spark.createDataFrame(text), pdf


def brute_sequences(pdf, keys, columns, target, window):
    """Every window, one by one."""
    found = {}
    for key, group in pdf.groupby(keys):
        group = group.sort_values("Date")
        values = group[list(columns)].to_numpy()
        for i in range(len(group) - window):
            found[(*key, group.Date.iloc[i + window])] = (values[i:i + window], group[target].iloc[i + window])
    return found


def split_by(df, train_end, val_end):
    def at(text):
        return F.lit(text).cast("timestamp_ntz")
    return df.withColumn("split", split_name(F.col("Date"), at(train_end), at(val_end)))


def settings(**changes):
    return Settings(**{"symbols": ("A", "B", "C"), "window": 4, "hidden_size": 3, "epochs": 2, **changes})
