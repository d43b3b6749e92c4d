"""The feature job over a folder that keeps receiving files.

The feature table is a projection without state, so the same function serves
batch and stream; scaling needs a fitted model and is applied as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpuslens.operators.features import linguistic_features
from corpuslens.operators.scaling import MinMaxModel


def stream_features(
    source: DataFrame, path: str, checkpoint: str, scaler: MinMaxModel | None = None, **trigger
) -> StreamingQuery:
    """Append the (scaled) features of every new document to a Parquet folder.

    Like the batch job it writes every row; readers drop rows without content text.
    """
    features = linguistic_features(source)
    if scaler is not None:
        features = scaler.transform(features)
    writer = features.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)
