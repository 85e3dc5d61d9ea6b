"""Human review of parsed records, and the choice of a series to show."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.text import sql_literal, strip
from plumbline.operators.series import CHUNK_POINTS, sql_chunk


def gated(kpis: DataFrame, approvals: DataFrame) -> DataFrame:
    """The KPIs with ``is_approved``: whether their parsed fields were confirmed. One join.

    One confirmation will do, however many decisions there are on a KPI.
    """
    confirmed = F.upper(strip(F.col("decision"))) == "Y"
    votes = approvals.groupBy("kpi_id").agg(F.max(confirmed).alias("is_approved"))
    return kpis.join(votes, "kpi_id", "left").withColumn(
        "is_approved", F.coalesce("is_approved", F.lit(False))
    )


def approved(kpis: DataFrame, approvals: DataFrame) -> DataFrame:
    """KPIs whose parsed fields were confirmed; only these go on to the checks."""
    return gated(kpis, approvals).where("is_approved").drop("is_approved")


def pending(kpis: DataFrame, approvals: DataFrame) -> DataFrame:
    return gated(kpis, approvals).where("NOT is_approved").drop("is_approved")


def field_review(parsed: DataFrame) -> DataFrame:
    """Parsed records as a listing to review: one row per field, list item and point.

    Expects the key and a ``parsed`` struct. Each record is expanded on its own; no shuffle.
    """

    def entry(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"))

    def scalar(field: str) -> Column:
        value = F.col(f"parsed.{field}")
        if field == "human_signoff_required":
            value = F.when(value, "True").when(~value, "False")
        return F.array(entry(field, F.coalesce(value, F.lit(V.FIELD_NOT_FOUND))))

    def listed(field: str) -> Column:
        items = F.col(f"parsed.{field}")
        return F.when(
            F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0,
            F.transform(items, lambda item: entry(field, item)),
        ).otherwise(F.array(entry(field, F.lit(V.LIST_EMPTY))))

    points = F.coalesce(
        F.col("parsed.historical_aggregates"),
        F.array().cast("array<struct<period:string,value:string>>"),
    )
    heading = F.array(
        entry("historical_aggregates", F.concat(F.size(points), F.lit(" data points")))
    )
    lines = F.transform(
        points,
        lambda point: entry(
            "historical_aggregates", F.concat_ws(": ", point["period"], point["value"])
        ),
    )
    listing = F.concat(
        *[scalar(field) for field in V.REVIEW_SCALAR_FIELDS],
        *[listed(field) for field in V.REVIEW_LIST_FIELDS],
        heading,
        lines,
    )
    return parsed.select(
        "kpi_id", F.posexplode(listing).alias("pos", "entry")
    ).select("kpi_id", (F.col("pos") + 1).alias("line_number"), "entry.*")


# The series to show: the first if it has points, else the second; too few points to chart and the
# placeholder takes its place.
_CHOICE = (
    f"CASE WHEN if(n_1 > 0, n_1, n_2) < {V.MIN_CHART_POINTS} THEN 'placeholder'"
    " WHEN n_1 > 0 THEN 'report' ELSE 'parsed' END"
)


def _tagged(kpis: DataFrame, first: DataFrame, second: DataFrame, *columns: str) -> DataFrame:
    """KPIs (tag 0) and the points of both series (1, 2) in one table, each source read once."""
    points = [
        series.where("kpi_id IS NOT NULL").select(F.lit(i).alias("tag"), "kpi_id", *columns)
        for i, series in ((1, first), (2, second))
    ]
    absent = [F.lit(None).cast(first.schema[c].dataType).alias(c) for c in columns]
    known = kpis.where("kpi_id IS NOT NULL").select(F.lit(0).alias("tag"), "kpi_id", *absent)
    return known.unionByName(points[0]).unionByName(points[1])


def _counts() -> list[Column]:
    return [F.expr(f"count_if(tag = {i}) AS n_{i}") for i in (0, 1, 2)]


def series_choice(kpis: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Per KPI, which series to show: the first if it has points, else the second, else none.

    A chosen series with too few points to chart is replaced by the placeholder. One aggregation.
    """
    counted = _tagged(kpis, first, second).groupBy("kpi_id").agg(*_counts()).where("n_0 > 0")
    return counted.select("kpi_id", F.expr(_CHOICE).alias("origin"))


def resolved_facts(kpis: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per KPI on the series to show: its origin, size, last and extreme values.

    All candidates are summed up in the same aggregation and the choice is made on its result.
    """
    facts = [
        F.expr(f"{rule} FILTER (WHERE tag = {i}) AS {name}_{i}")
        for i in (1, 2)
        for name, rule in {
            "latest_value": "max_by(value, if(value IS NULL, NULL, ord))",
            "min_value": "min(value)",
            "max_value": "max(value)",
        }.items()
    ]
    tagged = _tagged(kpis, first, second, "ord", "value")
    counted = tagged.groupBy("kpi_id").agg(*_counts(), *facts).where("n_0 > 0")
    values = [value for _, value in V.PLACEHOLDER_SERIES]
    fixed = {
        "n": f"{len(values)}L",
        "latest_value": f"{float(values[-1])}D",
        "min_value": f"{float(min(values))}D",
        "max_value": f"{float(max(values))}D",
    }

    def of_origin(name: str) -> str:
        return f"CASE origin WHEN 'report' THEN {name}_1 WHEN 'parsed' THEN {name}_2 ELSE {fixed[name]} END"

    return counted.selectExpr("*", f"{_CHOICE} AS origin").selectExpr(
        "kpi_id",
        "origin",
        "origin = 'placeholder' AS is_synthetic",
        f"{of_origin('n')} AS n_points",
        *[f"{of_origin(name)} AS {name}" for name in list(fixed)[1:]],
    )


def series_fallback(
    kpis: DataFrame, first: DataFrame, second: DataFrame, chunk_points: int = CHUNK_POINTS
) -> DataFrame:
    """The series to show for every KPI, with its origin and whether it is synthetic.

    All candidates go through one exchange by KPI and chunk of the series, which the counts and the
    points share; a KPI with very many points is spread over its chunks.
    """
    placeholder = ", ".join(
        f"named_struct('ord', {i}L, 'period', {sql_literal(period)}, 'value', {float(value)}D)"
        for i, (period, value) in enumerate(V.PLACEHOLDER_SERIES)
    )
    return kpis.sparkSession.sql(
        f"""WITH dealt AS (
  SELECT /*+ REPARTITION(kpi_id, chunk) */ tag, kpi_id, ord, period, value,
    {sql_chunk(int(chunk_points))} AS chunk
  FROM {{points}} WHERE monotonically_increasing_id() >= 0  -- keeps Spark from reading them twice
),
counted AS (
  SELECT kpi_id, chunk, count_if(tag = 0) AS n_0, count_if(tag = 1) AS n_1, count_if(tag = 2) AS n_2
  FROM dealt GROUP BY kpi_id, chunk
),
summed AS (
  SELECT kpi_id, chunk, sum(n_0) OVER whole AS n_0, sum(n_1) OVER whole AS n_1, sum(n_2) OVER whole AS n_2
  FROM counted WINDOW whole AS (PARTITION BY kpi_id)
),
choice AS (SELECT kpi_id, chunk, {_CHOICE} AS origin FROM summed WHERE n_0 > 0),
shown AS (
  SELECT kpi_id, origin, CASE
      WHEN tag = 0 AND origin = 'placeholder' THEN array({placeholder})
      WHEN tag = 1 AND origin = 'report' OR tag = 2 AND origin = 'parsed'
      THEN array(named_struct('ord', ord, 'period', period, 'value', value)) END AS points
  FROM dealt JOIN choice USING (kpi_id, chunk)
)
SELECT kpi_id, inline(points), origin, origin = 'placeholder' AS is_synthetic FROM shown""",
        points=_tagged(kpis, first, second, "ord", "period", "value"),
    )
