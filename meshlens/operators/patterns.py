"""Structural pattern detection and job-lifecycle analytics (§2.14 L-*).

Every detector is one group-by over (class ⋈ members on parent name = FQN)
with boolean flags aggregated by ``max`` / ``sum`` — the per-class Python loops
of the reference become a single shuffle on the class key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _members(classes: DataFrame, members: DataFrame) -> DataFrame:
    c = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"),
                       F.col("fqn").alias("class_fqn"), F.col("kind").alias("class_kind"))
    m = members.select(F.col("id").alias("member_id"), F.col("name").alias("m_name"), F.col("kind").alias("m_kind"),
                       F.col("access").alias("m_access"), F.col("parent_name").alias("class_fqn"),
                       F.col("return_type").alias("m_return"))
    return c.join(m, "class_fqn", "left")


def _flag(cond: Column) -> Column:
    return F.max(F.coalesce(cond, F.lit(False)).cast("int"))


def singleton(classes: DataFrame, members: DataFrame) -> DataFrame:
    """P-01: ≥ 2 of private ``instance`` field, private constructor, public
    instance accessor; confidence n/3."""
    j = _members(classes.where(F.col("kind") == "CLASS"), members)
    nm = F.lower(F.col("m_name"))
    g = j.groupBy("class_id", "class_name").agg(
        _flag((F.col("m_kind") == "VARIABLE") & (F.col("m_access") == "PRIVATE") & nm.contains("instance")).alias("f1"),
        _flag((F.col("m_kind") == "METHOD") & (F.col("m_name") == F.col("class_name"))
              & (F.col("m_access") == "PRIVATE")).alias("f2"),
        _flag((F.col("m_kind") == "METHOD") & (nm.contains("getinstance") | nm.contains("instance"))
              & (F.col("m_access") == "PUBLIC")).alias("f3"))
    n = F.col("f1") + F.col("f2") + F.col("f3")
    return (g.where(n >= 2).select("class_id", "class_name", F.lit("Singleton").alias("pattern"),
                                   F.round(n / 3.0, 4).alias("confidence")))


# Factory method keywords (P-02).
FACTORY_METHOD_WORDS = ("create", "make", "build", "get")
# CRUD keywords (P-03).
CRUD_WORDS = ("add", "get", "update", "delete", "find")


def factory(classes: DataFrame, members: DataFrame) -> DataFrame:
    """P-02: CLASS named like ``Factory`` with a create/make/build/get method, .8."""
    j = _members(classes.where((F.col("kind") == "CLASS") & F.lower("name").contains("factory")), members)
    nm = F.lower(F.col("m_name"))
    has = reduce(lambda a, b: a | b, [nm.contains(w) for w in FACTORY_METHOD_WORDS])
    g = j.groupBy("class_id", "class_name").agg(_flag((F.col("m_kind") == "METHOD") & has).alias("f"))
    return g.where(F.col("f") == 1).select("class_id", "class_name", F.lit("Factory").alias("pattern"),
                                           F.lit(0.8).alias("confidence"))


def repository(classes: DataFrame, members: DataFrame) -> DataFrame:
    """P-03: CLASS/INTERFACE named like ``Repository`` with ≥ 3 of the CRUD
    verbs among its METHOD names; confidence n/5."""
    j = _members(classes.where(F.col("kind").isin("CLASS", "INTERFACE") & F.lower("name").contains("repository")),
                 members)
    nm = F.lower(F.col("m_name"))
    flags = [_flag((F.col("m_kind") == "METHOD") & nm.contains(w)).alias(f"c_{w}") for w in CRUD_WORDS]
    g = j.groupBy("class_id", "class_name").agg(*flags)
    n = reduce(lambda a, b: a + b, [F.col(f"c_{w}") for w in CRUD_WORDS])
    return g.where(n >= 3).select("class_id", "class_name", F.lit("Repository").alias("pattern"),
                                  F.round(n / 5.0, 4).alias("confidence"))


def builder(classes: DataFrame, members: DataFrame) -> DataFrame:
    """P-04: CLASS named like ``Builder`` with a ``build`` method and ≥ 1 fluent
    method (return type mentions the class); confidence min(.9, .5 + .1n)."""
    j = _members(classes.where((F.col("kind") == "CLASS") & F.lower("name").contains("builder")), members)
    is_m = F.col("m_kind") == "METHOD"
    g = j.groupBy("class_id", "class_name").agg(
        _flag(is_m & (F.lower("m_name") == "build")).alias("has_build"),
        F.sum(F.when(is_m & F.col("m_return").isNotNull() & F.col("m_return").contains(F.col("class_name")), 1)
              .otherwise(0)).alias("fluent"))
    return (g.where((F.col("has_build") == 1) & (F.col("fluent") > 0))
            .select("class_id", "class_name", F.lit("Builder").alias("pattern"),
                    F.round(F.least(F.lit(0.9), 0.5 + F.col("fluent") * 0.1), 4).alias("confidence")))


# Observer name parts (P-05).
OBSERVER_WORDS = ("Observer", "Event", "Listener", "Handler")


def observer(classes: DataFrame) -> DataFrame:
    """P-05: class name contains Observer / Event / Listener / Handler, .7."""
    cond = reduce(lambda a, b: a | b, [F.col("name").contains(w) for w in OBSERVER_WORDS])
    return classes.where((F.col("kind") == "CLASS") & cond).select(
        F.col("id").alias("class_id"), F.col("name").alias("class_name"), F.lit("Observer").alias("pattern"),
        F.lit(0.7).alias("confidence"))


def layer_counts(classes_with_repo: DataFrame) -> DataFrame:
    """P-06: controller / service / repository class counts per repository."""
    n = F.lower("name")
    cls = F.col("kind") == "CLASS"
    return classes_with_repo.groupBy("repository").agg(
        F.count(F.when(cls & n.contains("controller"), 1)).alias("controllers"),
        F.count(F.when(cls & n.contains("service"), 1)).alias("services"),
        F.count(F.when(F.col("kind").isin("CLASS", "INTERFACE") & n.contains("repository"), 1)).alias("repositories"))


def long_methods(symbols: DataFrame, max_lines: int = 50, max_complexity: int = 15) -> DataFrame:
    """P-07: METHOD/FUNCTION longer than ``max_lines`` or more complex than
    ``max_complexity``."""
    lines = F.col("end_line") - F.col("start_line")
    return (symbols.where(F.col("kind").isin("METHOD", "FUNCTION")
                          & ((lines > max_lines) | (F.col("complexity") > max_complexity)))
            .select("id", "name", lines.alias("lines"), "complexity"))


# Clean-architecture layer folder names (P-08).
CLEAN_LAYERS = ("domain", "application", "infrastructure", "presentation")


def architecture_styles(files: DataFrame) -> DataFrame:
    """P-08: per repository: MVC (controller and model folders present) and
    clean architecture (≥ 3 of the 4 layer folders present)."""
    p = F.lower("path")
    g = files.groupBy("repository").agg(
        _flag(p.contains("controller")).alias("has_controllers"), _flag(p.contains("model")).alias("has_models"),
        *[_flag(p.contains(f"/{w}/") | p.startswith(f"{w}/")).alias(f"l_{w}") for w in CLEAN_LAYERS])
    n = reduce(lambda a, b: a + b, [F.col(f"l_{w}") for w in CLEAN_LAYERS])
    return g.select("repository", ((F.col("has_controllers") == 1) & (F.col("has_models") == 1)).alias("mvc"),
                    (n >= 3).alias("clean_architecture"))


def pattern_report(*detected: DataFrame) -> DataFrame:
    """P-11: all detector outputs unioned; per pattern the number of findings
    and their summed confidence (4-decimal confidences sum without a rounding
    tie, unlike an average; the mean is total / n)."""
    u = reduce(DataFrame.unionByName, [d.select("class_id", "pattern", "confidence") for d in detected])
    return u.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.sum("confidence"), 4).alias("total_confidence"))


# --------------------------------------------------------------------------- L-*

# Job statuses (L-01).
JOB_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "RETRYING")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")


def jobs_by_status(jobs: DataFrame, spark) -> DataFrame:
    """L-01: count per status with zeros kept, plus ``TOTAL``."""
    lit_statuses = spark.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    g = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    per = lit_statuses.join(g, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    total = jobs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("TOTAL").alias("status"), "n")
    return per.unionByName(total)


def stuck_jobs(jobs: DataFrame, asof: str, minutes: int = 60) -> DataFrame:
    """L-02: RUNNING and started before ``asof - minutes``."""
    cutoff = F.to_timestamp_ntz(F.lit(asof)) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return jobs.where((F.col("status") == "RUNNING") & (F.col("started_at") < cutoff))


def retention(jobs: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """L-04: terminal jobs last updated before ``asof - days`` are removed;
    returns the kept set."""
    cutoff = F.to_timestamp_ntz(F.lit(asof)) - F.expr(f"INTERVAL {int(days)} DAYS")
    drop = F.col("status").isin(list(TERMINAL)) & (F.col("updated_at") < cutoff)
    return jobs.where(~F.coalesce(drop, F.lit(False)))


def retry_eligible(jobs: DataFrame) -> DataFrame:
    """L-05: FAILED with retries left."""
    return jobs.where((F.col("status") == "FAILED") & (F.col("retry_count") < F.col("max_retries")))


def close_interrupted(jobs: DataFrame, asof: str) -> DataFrame:
    """L-06: RUNNING jobs become FAILED at ``asof`` with their duration in seconds."""
    at = F.to_timestamp_ntz(F.lit(asof))
    running = F.col("status") == "RUNNING"
    return jobs.select(
        "id", "repository_id",
        F.when(running, F.lit("FAILED")).otherwise(F.col("status")).alias("status"),
        F.when(running, F.timestamp_diff("SECOND", F.col("started_at"), at)).alias("duration_seconds"),
        F.when(running, F.lit("Job interrupted")).alias("error_message"))


def progress_pct(processed: Column, total: Column) -> Column:
    """L-07: processed / total · 100, 0 when total is 0."""
    return F.when(total > 0, F.round(processed * 100.0 / total, 2)).otherwise(F.lit(0.0))


def history_page(jobs: DataFrame, key: str, n: int = 10) -> DataFrame:
    """L-08: newest ``n`` jobs per repository (partial top-n per key before the shuffle)."""
    w = Window.partitionBy(key).orderBy(F.col("started_at").desc(), F.col("id").desc())
    return jobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --------------------------------------------------------------------------- P-09 service boundaries

HOST_BUILDERS = ("CreateBuilder", "CreateDefaultBuilder", "CreateApplicationBuilder")


def service_boundaries(projects: DataFrame, controllers: DataFrame) -> DataFrame:
    """P-09: service score per project from its project file, its startup file
    and its controller count: +50 Web / Worker SDK, +20 executable, +20 ASP.NET
    Core, +100 controllers, +50 DI registrations, +30 MediatR, +30 message bus,
    +100 host builder, +10 service-like name.  A service when a strong signal
    (controllers, host builder) is present or the score reaches 50; type API /
    Worker / Console by the same signals.

    ``projects``: id, name, project_xml, startup; ``controllers``: project_id, n."""
    px, st, name = F.coalesce(F.col("project_xml"), F.lit("")), F.coalesce(F.col("startup"), F.lit("")), F.col("name")
    web = px.contains('Sdk="Microsoft.NET.Sdk.Web"')
    worker = px.contains('Sdk="Microsoft.NET.Sdk.Worker"')
    exe = px.contains("<OutputType>Exe</OutputType>") | web | worker
    asp = px.contains("Microsoft.AspNetCore")
    di = st.contains("services.Add") | st.contains("builder.Services.Add")
    cqrs = st.contains("AddMediatR")
    bus = st.contains("AddMassTransit") | st.contains("AddNServiceBus")
    host = reduce(lambda a, b: a | b, [st.contains(h) for h in HOST_BUILDERS])
    named = name.endswith(".API") | name.endswith(".Service") | name.endswith(".Web")
    j = projects.join(controllers.withColumnRenamed("project_id", "id"), "id", "left")
    has_ctrl = F.coalesce(F.col("n"), F.lit(0)) > 0

    def pts(c, p):
        return F.when(c, F.lit(p)).otherwise(F.lit(0))

    score = (pts(web, 50) + pts(worker, 50) + pts(exe, 20) + pts(asp, 20) + pts(has_ctrl, 100) + pts(di, 50)
             + pts(cqrs, 30) + pts(bus, 30) + pts(host, 100) + pts(named, 10))
    is_service = has_ctrl | host | (score >= 50)
    api_name = name.contains(".API") | name.contains(".Api") | name.contains(".WebApi")
    stype = (F.when(~is_service, F.lit(None).cast("string"))
             .when(has_ctrl, "API")
             .when(web | asp, F.when(api_name, "API").otherwise("Worker"))
             .when(name.contains("Console") | name.contains("Cli"), "Console")
             .otherwise("Worker"))
    return j.select("id", "name", score.alias("score"), is_service.alias("is_service"), stype.alias("service_type"))
