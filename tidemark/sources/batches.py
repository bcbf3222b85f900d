"""How many bytes of payloads cross to Python at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: A batch is held several times over on its way (rows, a vector that doubles, the stream, Python), once a core.
BYTES = 8 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([bkmgt]?)b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def bounded(payloads: DataFrame) -> DataFrame:
    """The same rows; their session's Arrow batches have at most ``BYTES`` from now on (a row that is larger is a batch).

    The limit is a setting of the session, read when a plan runs; a smaller one stays.
    """
    conf = payloads.sparkSession.conf
    if _bytes(conf.get(_KEY)) > BYTES:
        conf.set(_KEY, BYTES)
    return payloads
