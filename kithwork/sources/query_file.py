"""Query files: one call a line, ``query1(p1, p2, x)`` to ``query4(k, tag)``; arguments hold no white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters by query type.
PARAMETERS = {
    1: (("p1", "bigint"), ("p2", "bigint"), ("x", "bigint")),
    2: (("k", "bigint"), ("d", "date")),
    3: (("k", "bigint"), ("h", "bigint"), ("place", "string")),
    4: (("k", "bigint"), ("tag", "string")),
}


def parse_lines(lines: DataFrame) -> dict[int, DataFrame]:
    """``lines`` (line_no, value) as one parameter table a type, with ``qid``: the position among the lines of that type."""
    from pyspark.sql import Window

    out = {}
    for kind, parameters in PARAMETERS.items():
        pattern = rf"^\s*query{kind}\(\s*" + r"\s*,\s*".join([r"([^\s,]+?)"] * len(parameters)) + r"\s*\)\s*$"
        own = lines.filter(F.col("value").rlike(pattern))
        # a query file is small next to the data: it is numbered as a whole
        qid = F.row_number().over(Window.orderBy("line_no")).cast("long") - 1
        columns = []
        for i, (name, type_) in enumerate(parameters, 1):
            text = F.regexp_extract("value", pattern, i)
            columns.append((F.to_date(text, "yyyy-M-d") if type_ == "date" else text.cast(type_)).alias(name))
        out[kind] = own.select(qid.alias("qid"), *columns)
    return out


def parse(spark: SparkSession, path: str) -> dict[int, DataFrame]:
    """The queries in the text file ``path``. The file is read as one value so that lines keep their order."""
    whole = spark.read.option("wholetext", True).text(path)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return parse_lines(lines)
