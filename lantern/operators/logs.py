"""Log lines against patterns in trailing time windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.runtime import cut

#: Fixed: most earlier lines of a pattern that count, and most anomalies that are kept.
MAX_HISTORY, MAX_ANOMALIES = 10_000, 1_000


@dataclass(frozen=True)
class LogPattern:
    """A regular expression, the count that is expected in its window, and the severity of more."""

    name: str
    regex: str
    severity: int
    threshold: float
    description: str = ""
    window_seconds: int = 300
    service: str | None = None


#: Fixed: the default catalogue.
DEFAULT_PATTERNS = (
    LogPattern("general_error", r"Error|Exception|Failed|Failure|Timeout", 3, 5.0),
    LogPattern("memory_error", r"OutOfMemory|OOM|memory\s+usage|memory\s+limit", 4, 1.0),
    LogPattern("cpu_error", r"CPU\s+usage|CPU\s+limit|high\s+CPU", 3, 1.0),
    LogPattern("disk_error", r"Disk\s+full|no\s+space\s+left|storage\s+limit", 4, 1.0),
    LogPattern("connection_error", r"Connection\s+refused|Connection\s+reset|Connection\s+timeout", 3, 3.0),
    LogPattern("auth_error", r"Authentication\s+failed|Unauthorized|Permission\s+denied|Access\s+denied", 3, 3.0),
    LogPattern("database_error", r"Database\s+error|SQL\s+error|query\s+failed", 4, 2.0),
    LogPattern("http_5xx", r"5[0-9]{2}|HTTP\s+5[0-9]{2}", 3, 5.0),
    LogPattern("http_4xx", r"4[0-9]{2}|HTTP\s+4[0-9]{2}", 2, 10.0),
    LogPattern("crash", r"Crash|Panic|Fatal|Segmentation\s+fault|SIGSEGV", 5, 1.0),
)


def pattern_table(spark: SparkSession, patterns: Sequence[LogPattern] = DEFAULT_PATTERNS) -> DataFrame:
    """The catalogue as a relation."""
    rows = [(p.name, p.regex, p.severity, p.description, p.service, p.threshold, p.window_seconds) for p in patterns]
    return spark.createDataFrame(rows, "name string, regex string, severity int, description string, service string, threshold double, window_seconds int")


def update_baseline(patterns: Sequence[LogPattern], name: str, expected: float) -> list[LogPattern]:
    """The catalogue with another expected count for a known pattern; unknown names change nothing."""
    return [replace(p, threshold=float(expected)) if p.name == name else p for p in patterns]


def match_patterns(logs: DataFrame, patterns: Sequence[LogPattern] = DEFAULT_PATTERNS, message: str = "message") -> DataFrame:
    """A row for each line and pattern that is found in it, in one pass with every expression compiled once.

    Adds ``pattern_name, severity, threshold, window_seconds``. A null message matches nothing.
    """
    found = [
        F.when(F.col(message).rlike(p.regex), F.struct(F.lit(p.name).alias("name"), F.lit(p.severity).alias("severity"), F.lit(p.threshold).alias("threshold"), F.lit(p.window_seconds).alias("window")))
        for p in patterns
    ]
    hits = logs.withColumn("__hit", F.explode(F.array_compact(F.array(*found))))
    return hits.select(
        *logs.columns, F.col("__hit.name").alias("pattern_name"), F.col("__hit.severity").alias("severity"), F.col("__hit.threshold").alias("threshold"), F.col("__hit.window").alias("window_seconds")
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def windowed_count(matches: DataFrame, windows: Sequence[int] = (300,), ts: str = "ts", seq: str = "seq", samples: bool = False, message: str = "message") -> DataFrame:
    """``n_in_window``: lines of the same pattern from ``window_seconds`` before up to this line, both ends included.

    A line of the same instant counts when its ``seq`` isn't greater. Each row is dealt to the time
    bucket it lies in and to the next, so one pattern is counted by many tasks and every row still
    sees its whole window; the copy is dropped afterwards. With ``samples`` the first ten messages
    of the window come along.
    """
    if len(windows) > 1:
        parts = [windowed_count(matches.where(F.col("window_seconds") == w), [w], ts, seq, samples, message) for w in sorted(set(windows))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    span = windows[0] * 1_000_000
    timed = matches.where(F.col("window_seconds") == windows[0]).withColumn("__us", micros(F.col(ts)))
    home = F.floor(F.col("__us") / max(1, span)).cast("long")
    dealt = timed.withColumn("__home", home).withColumn("__bucket", F.explode(F.array("__home", F.col("__home") + 1)))
    key = ["pattern_name", "__bucket"]
    trailing = Window.partitionBy(*key).orderBy("__us").rangeBetween(-span, 0)
    same = Window.partitionBy(*key, "__us")
    count = F.count("*").over(trailing) - F.count("*").over(same) + F.row_number().over(same.orderBy(seq))
    out = dealt.withColumn("n_in_window", count.cast("long"))
    if samples:
        # Lines of a bucket are numbered; a window is a run of numbers, of which ten are looked up.
        up_to = Window.partitionBy(*key).orderBy("__us").rangeBetween(Window.unboundedPreceding, 0)
        whole = F.count("*").over(trailing)
        out = cut(out.withColumns({"__in": whole, "__start": F.count("*").over(up_to) - whole + 1, "__place": F.row_number().over(Window.partitionBy(*key).orderBy("__us", seq))}))
        starts = out.where("__bucket = __home").groupBy(*key, "__start").agg(F.max(F.least("__in", F.lit(10))).alias("__ten"))
        wanted = starts.select(F.col("pattern_name").alias("__p"), F.col("__bucket").alias("__b"), F.col("__start").alias("__s"), F.posexplode(F.sequence(F.col("__start"), F.col("__start") + F.col("__ten") - 1)).alias("__i", "__at"))
        texts = out.select(F.col("pattern_name").alias("__tp"), F.col("__bucket").alias("__tb"), F.col("__place").alias("__tat"), F.col(message).alias("__text"))
        found = wanted.join(texts, F.expr("__p = __tp and __b = __tb and __at = __tat")).groupBy("__p", "__b", "__s").agg(F.array_sort(F.collect_list(F.struct("__i", "__text"))).alias("__t"))
        joined = out.where("__bucket = __home").join(found, F.expr("pattern_name = __p and __bucket = __b and __start = __s"))
        some = F.slice(F.transform("__t", lambda x: x["__text"]), F.lit(1), F.least(F.col("__in"), F.lit(10)).cast("int"))
        out = joined.withColumn("log_samples", some).drop("__in", "__start", "__place", "__p", "__b", "__s", "__t")
    return out.where("__bucket = __home").drop("__us", "__home", "__bucket")


def anomaly_score(count: Column, expected: Column) -> Column:
    """0 up to the expected count, 1 at ten times it; any line is 1 where none is expected."""
    ratio = count / expected
    return (
        F.when(expected == 0, F.when(count > 0, 1.0).otherwise(0.0))
        .when(ratio <= 1, 0.0)
        .otherwise(F.least(F.lit(1.0), (ratio - 1) / 9))
    )


def detect(logs: DataFrame, patterns: Sequence[LogPattern] = DEFAULT_PATTERNS, samples: bool = False) -> DataFrame:
    """Anomalies of log lines: matched lines whose windowed count is above what is expected.

    ``pattern_name, service, ts, seq, count, expected, score, severity, is_anomaly``. A count is one
    over the bound of the history at most.
    """
    counted = windowed_count(match_patterns(logs, patterns), sorted({p.window_seconds for p in patterns}), samples=samples)
    count = F.least(F.col("n_in_window"), F.lit(MAX_HISTORY + 1))
    scored = counted.withColumn("count", count).withColumn("expected", F.col("threshold")).withColumn("score", anomaly_score(F.col("count"), F.col("expected")))
    more = ["log_samples"] if samples else []
    return scored.where("score > 0").select("pattern_name", "service", "ts", "seq", "count", "expected", "score", "severity", (F.col("score") > 0.5).alias("is_anomaly"), *more)


def newest_anomalies(anomalies: DataFrame, most: int = MAX_ANOMALIES) -> DataFrame:
    """The history that is kept: the ``most`` newest anomalies."""
    return anomalies.orderBy(F.desc("ts"), F.desc("seq"), "pattern_name").limit(most)


def get_anomalies(anomalies: DataFrame, since=None, service: str | None = None, min_severity: int = 1, min_score: float = 0.5) -> DataFrame:
    """Anomalies not before ``since``, of a service, and of that severity and score at least."""
    out = anomalies.where((F.col("severity") >= min_severity) & (F.col("score") >= min_score))
    out = out if since is None else out.where(F.col("ts") >= F.lit(since))
    return out if service is None else out.where(F.col("service") == service)


def get_anomaly_count(anomalies: DataFrame, **filters) -> DataFrame:
    """One row with ``n_anomalies``."""
    return get_anomalies(anomalies, **filters).agg(F.count("*").alias("n_anomalies"))


def extract_service(line: Column) -> Column:
    """The service of a raw line: of a pod name in brackets, else of a JSON field, else before a colon, else ``default``."""
    pod = F.nullif(F.regexp_extract(line, r"\[([a-zA-Z0-9-]+)-[a-z0-9]+-[a-z0-9]+\]", 1), F.lit(""))
    field = F.get_json_object(line, "$.service")
    prefix = F.nullif(F.regexp_extract(line, r"^([a-zA-Z0-9-]+):", 1), F.lit(""))
    return F.coalesce(pod, field, prefix, F.lit("default"))


def log_buffer(logs: DataFrame, count: int | None = None, since=None, max_size: int = 1000) -> DataFrame:
    """The last ``count`` lines not before ``since`` of the newest ``max_size`` lines."""
    newest = logs.orderBy(F.desc("ts"), F.desc("seq")).limit(max_size)
    kept = newest if since is None else newest.where(F.col("ts") >= F.lit(since))
    return kept if count is None else kept.orderBy(F.desc("ts"), F.desc("seq")).limit(count)


def union_logs(*sources: DataFrame) -> DataFrame:
    """Lines of several sources, columns by name; works on streams too."""
    out = sources[0]
    for x in sources[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
