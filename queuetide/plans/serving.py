"""Batch form of the predict call: validate requests, predict, shape the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FORECAST_KEYS, KEY, TS
from ..functions.numbers import round_even


def validate_requests(requests: DataFrame, known: list[str] | None = None) -> DataFrame:
    """``status`` 200 or 400 with a message; valid rows get an upper-case key and ``at``."""
    codes = [k.upper() for k in (known or FORECAST_KEYS)]
    no_ts = F.coalesce(F.col(TS), F.lit("")) == ""
    no_key = F.coalesce(F.col(KEY), F.lit("")) == ""
    code = F.upper(F.col(KEY))
    at = F.try_to_timestamp(F.col(TS)).cast("timestamp_ntz")
    # The wording of the messages.
    example = "e.g., /predict?airport=ARN&timestamp=YYYY-MM-DDTHH:MM"
    message = (
        F.when(no_ts & no_key, f'Missing "airport" and "timestamp". {example}')
        .when(no_ts, f'Missing "timestamp". {example}')
        .when(no_key, f'Missing "airport". {example}')
        .when(~code.isin(codes), F.concat(F.lit('Invalid airport code "'), code,
                                          F.lit(f'". Valid codes: {",".join(codes)}.')))
        .when(at.isNull(), 'Invalid "timestamp". Expected YYYY-MM-DDTHH:MM (UTC)'))
    return (requests.withColumn("error", message)
            .withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))
            .withColumns({"at": F.when(F.col("status") == 200, at),
                          KEY: F.when(F.col("status") == 200, code).otherwise(F.col(KEY))}))


def predict_response(predicted: DataFrame, ts: str = "at") -> DataFrame:
    """Whole minutes, one-decimal bands and a ``Z`` timestamp."""
    return predicted.withColumns({
        "predicted_queue_length_minutes": round_even("q50").cast("int"),
        "p10": round_even("q10", 1), "p50": round_even("q50", 1), "p90": round_even("q90", 1),
        "answered_for": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }).drop("q10", "q50", "q90")
