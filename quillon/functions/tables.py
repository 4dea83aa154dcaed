"""Table functions for SQL: ``SELECT * FROM frames, LATERAL visual_inspect(frames.spans, 2.0, 8)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

SPANS = "array<struct<start_sec: double, end_sec: double>>"


class _Inspect:
    """The moments to look at in spans: every ``step`` seconds from each start on, the ends left out, at most ``most`` in all, each once."""

    def eval(self, spans: list | None, step: float | None, most: int | None) -> Iterator[tuple[int, float]]:
        seen: set[float] = set()
        if not spans or step is None or step <= 0 or most is None:
            return
        for i, s in enumerate(spans):
            if s is None or s["start_sec"] is None or s["end_sec"] is None:
                continue
            n = 0
            while (t := s["start_sec"] + n * step) < s["end_sec"] and len(seen) < most:
                n += 1
                if t not in seen:
                    seen.add(t)
                    yield i, t


visual_inspect = udtf(_Inspect, returnType="span int, moment double")


def register(spark: SparkSession) -> None:
    """Makes ``visual_inspect`` known to SQL."""
    spark.udtf.register("visual_inspect", visual_inspect)


def moments(rows: DataFrame, keys: list[str], spans: Column, step: float, most: int) -> DataFrame:
    """keys, span, moment: what ``visual_inspect`` gives, by column expressions."""
    made = F.filter(
        F.flatten(
            F.transform(
                spans,
                lambda s, i: F.transform(
                    F.when(s["start_sec"] < s["end_sec"], F.sequence(F.lit(0), (F.ceil((s["end_sec"] - s["start_sec"]) / step) - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
                    lambda n: F.struct(i.alias("span"), (s["start_sec"] + n * step).alias("moment")),
                ),
            )
        ),
        lambda x: x.isNotNull(),
    )
    first = F.aggregate(made, F.slice(made, 1, 0), lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: y["moment"] == x["moment"]), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select(*keys, F.inline(first))
