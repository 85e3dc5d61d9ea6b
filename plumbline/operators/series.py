"""Series screening: statistics, outliers, step changes and their roll-up per KPI.

The layout is chosen for series of any length. Points are shuffled once, by KPI and by chunk
of the series, so that one very long series spreads over many tasks. Each chunk yields one
summary row (counts, moments, last numeric point), combined on the map side before it is
shuffled; the summaries of a KPI are merged with windows over those few rows and joined back
to the points on the keys these are partitioned by already. Points without a kpi_id belong to
no series and are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.numbers import sql_is_real
from plumbline.functions.text import sql_literal

CHUNK_POINTS = 100_000

# Order of the anomaly kinds within a KPI; (kind_order, ord) sorts a KPI's anomalies.
KINDS = ["NonNumeric", "Outlier", "StepChange"]

_Z_SCORE = "bround(z, 2)"
_PCT_CHANGE = "bround(change * 100, 1)"

# Range below its allowed share of the maximum; NULL when it cannot be assessed.
SQL_STABLE_RANGE = (
    f"if(n_points >= {V.MIN_POINTS_FOR_TREND},"
    f" max_value - min_value < max_value * {V.STABLE_RANGE_SHARE}D, NULL)"
)
SQL_VARIATION = (
    f"if({sql_is_real('mean')} AND mean > 0, try_divide(stdev, mean), 0D)"
)
# Coefficient of variation above its floor, for a positive mean and enough points.
SQL_HAS_VARIATION = (
    f"coalesce(n_points >= {V.MIN_POINTS_FOR_TREND} AND {sql_is_real(SQL_VARIATION)}"
    f" AND {SQL_VARIATION} > {V.VARIATION_FLOOR}D, false)"
)


def series_stats(series: DataFrame) -> DataFrame:
    """Count, mean and population deviation of the numeric points, one row per KPI."""
    return series.groupBy("kpi_id").agg(
        F.expr("count(1) AS n_points"),
        F.expr("count(value) AS n_numeric"),
        F.expr("if(min(value) = max(value), min(value), avg(value)) AS mean"),
        F.expr("if(min(value) = max(value), 0D, stddev_pop(value)) AS stdev"),
        F.expr("min(value) AS min_value"),
        F.expr("max(value) AS max_value"),
    )


def series_spread(series: DataFrame) -> DataFrame:
    """Range and coefficient of variation per KPI with the two tests built on them."""
    return series_stats(series).selectExpr(
        "kpi_id",
        "n_points",
        "min_value",
        "max_value",
        "max_value - min_value AS spread",
        f"{SQL_VARIATION} AS variation",
        f"{SQL_STABLE_RANGE} AS stable_range",
        f"{SQL_HAS_VARIATION} AS has_variation",
    )


# Points are read once and dealt by series and chunk; every later step reads that one exchange. What
# makes Spark keep a common table expression instead of computing it at each place it is named is an
# expression it must not repeat, here a test of the row's number that always holds. The columns are
# those that the caller uses: if Spark could drop one, it would deal the points once more.
_DEALT = """
dealt AS (
  SELECT /*+ REPARTITION(kpi_id, chunk) */ kpi_id, ord, value, {chunk} AS chunk{more}
  FROM {{points}} WHERE kpi_id IS NOT NULL AND monotonically_increasing_id() >= 0
)"""

# One row per KPI and chunk, carrying what later chunks and the whole KPI need. Numbers only, which
# keeps the aggregation a hash one; the label of the carried point is looked up by its `ord`.
_SUMMARIES = """
parts AS (
  SELECT kpi_id, chunk,
    count(value) AS part_n, avg(value) AS part_mean, var_pop(value) AS part_var,
    min(value) AS part_min, max(value) AS part_max,
    max(if(value IS NULL, NULL, ord)) AS last_ord,
    coalesce(max_by(value, if(value IS NULL, NULL, ord)), max(if(ord IS NULL, value, NULL))) AS last_value
  FROM dealt GROUP BY kpi_id, chunk
),
merged AS (
  SELECT kpi_id, chunk, part_n, part_mean, part_var,
    last(last_value, true) OVER earlier AS carried_value,
    last(last_ord, true) OVER earlier AS carried_ord,
    last(if(part_n > 0, chunk, NULL), true) OVER earlier AS carried_chunk,
    sum(part_n) OVER whole AS n_numeric,
    min(part_min) OVER whole AS min_value,
    max(part_max) OVER whole AS max_value,
    try_divide(sum(part_n * part_mean) OVER whole, sum(part_n) OVER whole) AS merged_mean
  FROM parts
  WINDOW whole AS (PARTITION BY kpi_id),
    earlier AS (PARTITION BY kpi_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
summaries AS (
  SELECT kpi_id, chunk, carried_value, carried_ord, carried_chunk, n_numeric, min_value, max_value,
    if(min_value = max_value, min_value, merged_mean) AS mean,
    if(min_value = max_value, 0D, sqrt(try_divide(
      sum(part_n * (part_var + (part_mean - merged_mean) * (part_mean - merged_mean)))
        OVER (PARTITION BY kpi_id),
      n_numeric))) AS stdev
  FROM merged
)"""

_FOLLOWED = """
followed AS (
  SELECT dealt.*,
    last(value, true) OVER before AS previous_value{label}
  FROM dealt
  WINDOW before AS (PARTITION BY kpi_id, chunk ORDER BY ord, value{ties}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""

_CARRIED_LABELS = """
labels AS (
  SELECT s.kpi_id, s.chunk, max(d.period) AS carried_period
  FROM summaries s JOIN dealt d
    ON d.kpi_id = s.kpi_id AND d.chunk = s.carried_chunk AND d.ord <=> s.carried_ord
    AND d.value = s.carried_value
  GROUP BY s.kpi_id, s.chunk
)"""


def sql_chunk(chunk_points: int) -> str:
    """A point's chunk; points without an ``ord`` come before all others."""
    return f"coalesce(ord div {chunk_points}, {-(2**63) // chunk_points - 1})"


def _screened(
    series: DataFrame,
    query: str,
    z_threshold: float = V.Z_SCORE_THRESHOLD,
    step_threshold: float = V.STEP_CHANGE_THRESHOLD,
    chunk_points: int = CHUNK_POINTS,
    texts: tuple[str, ...] = ("period", "value_raw"),
    from_labels: bool = True,
    more: str = "",
) -> DataFrame:
    """The result of a query over ``screened``, the points with what screening says of each.

    ``texts`` names the text columns of the points that the query uses.
    """
    absent = {c: F.lit(None).cast("string") for c in texts if c not in series.columns}
    points = series.withColumns(absent) if absent else series
    from_labels = from_labels and "period" in texts
    # An absent period cannot be told from an absent point, so the label is boxed.
    label = (
        ",\n    last(if(value IS NULL, NULL, array(period)), true) OVER before[0] AS previous_period"
        if from_labels
        else ""
    )
    listed = "".join(f", {c}" for c in texts)
    steps = [
        _DEALT.format(chunk=sql_chunk(int(chunk_points)), more=listed),
        _SUMMARIES,
        _FOLLOWED.format(label=label, ties=", period" if "period" in texts else ""),
    ]
    from_period, join = "", ""
    if from_labels:
        steps.append(_CARRIED_LABELS)
        join = "LEFT JOIN labels USING (kpi_id, chunk)"
        from_period = ", if(previous_value IS NULL, carried_period, previous_period) AS from_period"
    steps.append(f"""
linked AS (
  SELECT kpi_id, chunk, ord{listed}, value, n_numeric, mean, stdev, min_value, max_value,
    coalesce(previous_value, carried_value) AS from_value{from_period}
  FROM followed JOIN summaries USING (kpi_id, chunk) {join}
),
measured AS (
  SELECT *,
    if(n_numeric >= {V.MIN_POINTS_FOR_TREND} AND stdev > 0,
      abs(try_divide(value - mean, stdev)), NULL) AS z,
    try_divide(value - from_value, from_value) AS change
  FROM linked
),
screened AS (
  SELECT *,
    value IS NULL AS is_non_numeric,
    {sql_is_real('z')} AND z >= {float(z_threshold)}D AS is_outlier,
    {sql_is_real('change')} AND abs(change) >= {float(step_threshold)}D AS is_step_change
  FROM measured
)""")
    return series.sparkSession.sql(f"WITH {','.join(steps)}{more}\n{query}", points=points)


def screen_points(series: DataFrame, **options) -> DataFrame:
    """Every point with its series' statistics, its z score and the change from the last number.

    Options are ``z_threshold``, ``step_threshold``, ``chunk_points``, ``texts`` and ``from_labels``.
    ``chunk_points`` only sets how a long series is divided among tasks, never the result. It
    counts in units of ``ord``, which should therefore be near to a dense position;
    ``functions.ordering.with_rank`` makes one from a timestamp or any other sort key. Points
    without an ``ord`` come before all others, by value. ``texts`` names the text columns to
    carry along, and ``from_labels`` may be switched off where ``from_period`` is not needed.
    """
    return _screened(series, "SELECT * EXCEPT (chunk) FROM screened", **options)


def non_numeric_points(series: DataFrame) -> DataFrame:
    """Points of a KPI whose value is missing or not a number. No shuffle."""
    return series.where("value IS NULL AND kpi_id IS NOT NULL").select(
        "kpi_id", "ord", "period", "value_raw", F.lit(V.NON_NUMERIC_NOTE).alias("note")
    )


def outliers(series: DataFrame, **options) -> DataFrame:
    return (
        screen_points(series, texts=("period",), from_labels=False, **options)
        .where("is_outlier")
        .selectExpr(
            "kpi_id",
            "ord",
            "period",
            "value",
            "z",
            f"{_Z_SCORE} AS z_score",
            f"{sql_literal(V.OUTLIER_NOTE)} AS note",
        )
    )


def step_changes(series: DataFrame, **options) -> DataFrame:
    return (
        screen_points(series, texts=("period",), **options)
        .where("is_step_change")
        .selectExpr(
            "kpi_id",
            "ord",
            "from_period",
            "period AS to_period",
            "from_value",
            "value AS to_value",
            "change",
            f"{_PCT_CHANGE} AS pct_change",
            f"{sql_literal(V.STEP_CHANGE_NOTE)} AS note",
        )
    )


_ANOMALY_FIELDS = {
    "kind_order": "int",
    "type": "string",
    "period": "string",
    "value_raw": "string",
    "value": "double",
    "z_score": "double",
    "from_period": "string",
    "to_period": "string",
    "from_value": "double",
    "to_value": "double",
    "pct_change": "double",
    "note": "string",
}


def _anomaly(kind: str, note: str, **fields: str) -> str:
    values = {
        "kind_order": str(KINDS.index(kind) + 1),
        "type": sql_literal(kind),
        "note": sql_literal(note),
        **fields,
    }
    columns = [
        f"{sql_literal(name)}, cast({values.get(name, 'NULL')} AS {kind_type})"
        for name, kind_type in _ANOMALY_FIELDS.items()
    ]
    return f"named_struct({', '.join(columns)})"


def anomalies(series: DataFrame, **options) -> DataFrame:
    """All anomalies in one long table, sorted within a KPI by (kind_order, ord)."""
    outlier = _anomaly(
        "Outlier", V.OUTLIER_NOTE, period="period", value="value", z_score=_Z_SCORE
    )
    step = _anomaly(
        "StepChange",
        V.STEP_CHANGE_NOTE,
        from_period="from_period",
        to_period="period",
        from_value="from_value",
        to_value="value",
        pct_change=_PCT_CHANGE,
    )
    unread = _anomaly("NonNumeric", V.NON_NUMERIC_NOTE, period="period", value_raw="value_raw")
    return (
        screen_points(series, **options)
        .where("is_non_numeric OR is_outlier OR is_step_change")
        .selectExpr(
            "kpi_id",
            "ord",
            f"inline(CASE WHEN is_non_numeric THEN array({unread})"
            f" WHEN NOT is_step_change THEN array({outlier})"
            f" WHEN NOT is_outlier THEN array({step}) ELSE array({outlier}, {step}) END)",
        )
    )


def quality_rollup(series: DataFrame, **options) -> DataFrame:
    """One row per KPI: statistics, last value and the number of anomalies of each kind."""
    constant_over_kpi = ["n_numeric", "mean", "stdev", "min_value", "max_value"]
    return (
        screen_points(series, texts=(), **options)
        .groupBy("kpi_id")
        .agg(
            F.expr("count(1) AS n_points"),
            *[F.expr(f"max({name}) AS {name}") for name in constant_over_kpi],
            F.expr("max_by(value, if(value IS NULL, NULL, ord)) AS latest_value"),
            F.expr("count_if(is_non_numeric) AS non_numeric_count"),
            F.expr("count_if(is_outlier) AS outlier_count"),
            F.expr("count_if(is_step_change) AS step_change_count"),
        )
    )


def quality_columns() -> dict[str, Column]:
    """Status columns derived from a (possibly missing) row of ``quality_rollup``."""
    count = "coalesce(non_numeric_count + outlier_count + step_change_count, 0)"

    def choose(clean: str, otherwise: str) -> Column:
        return F.expr(f"if({count} = 0, {sql_literal(clean)}, {sql_literal(otherwise)})")

    return {
        "n_points": F.expr("coalesce(n_points, 0)"),
        "anomaly_count": F.expr(count),
        "anomalies_detected": choose("No", "Yes"),
        "quality_status": choose(V.QUALITY_PASS[0], V.QUALITY_REVIEW[0]),
        "quality_notes": choose(V.QUALITY_PASS[1], V.QUALITY_REVIEW[1]),
    }


def registry_left_series(registry: DataFrame, series: DataFrame, **options) -> DataFrame:
    """Every registered KPI with its series roll-up; a KPI without points counts as clean."""
    rollup = quality_rollup(series, **options)
    return registry.join(rollup, "kpi_id", "left").withColumns(quality_columns())


def chart_points(series: DataFrame, match: str = "label", **options) -> DataFrame:
    """Every point of a series with the marks to draw on it.

    With ``match="label"`` a mark goes to the first point carrying the anomaly's period label;
    with ``match="position"`` to the very point. The two agree where labels are unique.
    A point may take several marks under "label"; counts are kept and the earliest is shown.
    """
    if match not in ("label", "position"):
        raise ValueError("match must be 'label' or 'position'")
    if match == "position":
        return screen_points(series, texts=("period",), from_labels=False, **options).selectExpr(
            "kpi_id",
            "ord",
            "period",
            "value",
            "cast(is_outlier AS bigint) AS outlier_marks",
            f"if(is_outlier, {_Z_SCORE}, NULL) AS z_score",
            "cast(is_step_change AS bigint) AS step_marks",
            f"if(is_step_change, {_PCT_CHANGE}, NULL) AS pct_change",
        )
    # One row per label, combined on the map side, so that a label repeated very often stays one
    # row; it goes back to the first point of that label, in whose chunk the points lie already.
    marks = f""",
first_of_label AS (
  SELECT kpi_id, min(ord) AS ord,
    count_if(is_outlier) AS outlier_marks,
    min_by({_Z_SCORE}, if(is_outlier, ord, NULL)) AS z_score,
    count_if(is_step_change) AS step_marks,
    min_by({_PCT_CHANGE}, if(is_step_change, ord, NULL)) AS pct_change
  FROM screened GROUP BY kpi_id, period
  HAVING count_if(is_outlier OR is_step_change) > 0
),
marks AS (SELECT *, {sql_chunk(options.get("chunk_points", CHUNK_POINTS))} AS chunk FROM first_of_label)"""
    return _screened(
        series,
        "SELECT kpi_id, ord, period, value, coalesce(outlier_marks, 0) AS outlier_marks, z_score,"
        " coalesce(step_marks, 0) AS step_marks, pct_change"
        " FROM screened LEFT JOIN marks USING (kpi_id, chunk, ord)",
        texts=("period",),
        from_labels=False,
        more=marks,
        **options,
    )
