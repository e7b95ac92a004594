"""Findings of checks: counts, decisions, joins with guides, rounds of repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Codes after which a run can't be judged (a parameter; these are the defaults).
UNJUDGEABLE = ("TEXT_LOSS",)


def counts(issues: DataFrame) -> DataFrame:
    """Errors, warnings and all findings of each run and phase."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return issues.groupBy("run_id", "phase").agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"), F.count("*").alias("n_issues"))


def assess(issues: DataFrame, unjudgeable: tuple[str, ...] = UNJUDGEABLE) -> DataFrame:
    """The decision on each run, with confidence, baseline, whether a person must review, and how many codes there are."""
    flags = issues.groupBy("run_id").agg(
        F.max(F.col("code").isin(*unjudgeable).cast("int")).alias("blind"), F.max((F.col("severity") == "error").cast("int")).alias("error"), F.max((F.col("severity") == "warning").cast("int")).alias("warning"),
        *[F.max((F.col("phase") == p).cast("int")).alias(p) for p in ("structural", "strict", "visual")], F.countDistinct("code").alias("n_codes"),
    )
    decision = F.when(F.col("blind") == 1, "BLOCKED_UNJUDGEABLE").when(F.col("error") == 1, "FAILED_AUTOMATIC").when(F.col("warning") == 1, "PASSED_WITH_REVIEW").otherwise("PASSED_MACHINE")
    t = flags.withColumn("decision", decision)
    both = (F.col("structural") == 1) & (F.col("strict") == 1)
    confidence = F.when(F.col("decision").isin("BLOCKED_UNJUDGEABLE", "FAILED_AUTOMATIC"), "high").when(both & (F.col("visual") == 1) & (F.col("decision") == "PASSED_MACHINE"), "high").when(both, "medium").otherwise("low")
    return t.select("run_id", "decision", confidence.alias("confidence"), F.when(F.col("visual") == 1, "visual_render").otherwise("machine_reports").alias("baseline"), (F.col("decision") != "PASSED_MACHINE").alias("review"), "n_codes")


def codes_in_order(issues: DataFrame) -> DataFrame:
    """The distinct codes of each run in the order of their first place."""
    first = issues.groupBy("run_id", "code").agg(F.min("ord").alias("first"))
    return first.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]), ",").alias("codes"))


def review_pages(issues: DataFrame) -> DataFrame:
    """The distinct positive pages of each run, ascending."""
    return issues.where("page > 0").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"))


def repair_plan(issues: DataFrame, guides: DataFrame) -> DataFrame:
    """Each run's steps: its codes with their guides(code, action, level), errors first, then warnings, then the rest.

    guides is a vocabulary of codes; Spark broadcasts it if it is small.
    """
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    steps = issues.groupBy("run_id", "code").agg(F.min(F.struct(rank.alias("rank"), "ord")).alias("m"))
    steps = steps.join(guides, "code", "left").select("run_id", "code", F.coalesce("action", F.lit("inspect")).alias("action"), F.coalesce("level", F.lit("manual")).alias("level"), "m.rank", "m.ord")
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("rank", "ord"))).select("run_id", "step", "code", "action", "level")


def rounds(issues: DataFrame, round_of) -> DataFrame:
    """New and resolved codes of each round of a run against the round before."""
    sets = issues.withColumn("round", round_of).groupBy("run_id", "round").agg(F.collect_set("code").alias("codes"))
    before = F.lag("codes").over(Window.partitionBy("run_id").orderBy("round"))
    t = sets.withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return t.select("run_id", "round", text(F.array_except("codes", "before")).alias("new_codes"), text(F.array_except("before", "codes")).alias("resolved_codes"))


def majority(results: DataFrame) -> DataFrame:
    """For each doc_id, the signature that two runs or more agree on (the first seen), of results(doc_id, run, signature)."""
    t = results.groupBy("doc_id", "signature").agg(F.count("*").alias("n"), F.min("run").alias("first")).where("n >= 2")
    return t.groupBy("doc_id").agg(F.min_by(F.struct("signature", "n"), "first").alias("m")).select("doc_id", "m.signature", "m.n")


def intersection(items: DataFrame, key: str, run: str) -> DataFrame:
    """Keys that all runs have."""
    n = items.agg(F.countDistinct(run).alias("__all"))
    return items.groupBy(key).agg(F.countDistinct(run).alias("__n")).join(n, F.col("__n") == F.col("__all")).select(key)


def inherit(styles: DataFrame, columns: list[str], most_rounds: int = 40) -> DataFrame:
    """styles(id, parent, ...) with each column's first value that isn't null up the chain of parents, to its end.

    Doubling: after k rounds a row has looked 2**k ancestors up. Rounds go on while a row with a value missing has an
    ancestor left, at most as many as the number of styles has binary digits: by then every chain has ended, and a cycle has
    been gone round. A round is written to the shared folder where spark.checkpoint.dir names one.
    """
    t, spark = styles.select("id", "parent", *columns), styles.sparkSession
    rounds = min(most_rounds, int(t.count()).bit_length())
    reliable = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if reliable and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(reliable)
    for k in range(rounds):
        up = t.select(F.col("id").alias("__id"), F.col("parent").alias("__p"), *[F.col(c).alias(f"__{c}") for c in columns])
        t = t.join(up, t.parent == up["__id"], "left").select("id", F.col("__p").alias("parent"), *[F.coalesce(c, f"__{c}").alias(c) for c in columns])
        if k % 4 == 3:
            t = t.checkpoint() if reliable else t
            missing = " OR ".join(f"`{c}` IS NULL" for c in columns)
            if not t.where(f"parent IS NOT NULL AND ({missing})").limit(1).count():
                break
    return t.drop("parent")


def owned(issues: DataFrame, guides: DataFrame, owners: DataFrame, mode: str = "user", usual: str = "renderer") -> DataFrame:
    """issues(run_id, ord, code, severity, message, detail) as steps of repair: title, why, counts, level and target.

    guides(code, title, why, level) and owners(code, owner) are vocabularies. Numbers of a detail such as `a=1, b=2` are its
    counts. What needs the user or the environment is theirs; else, in user mode, the run's script; else the code's owner.
    """
    t = issues.join(guides, "code", "left").join(owners, "code", "left")
    level = F.coalesce("level", F.lit("manual_review"))
    target = F.when(level == "needs_environment", "environment").when(level.startswith("needs_user"), "user").when(F.lit(mode == "user"), "run script").otherwise(F.coalesce("owner", F.lit(usual)))
    pairs = F.regexp_extract_all(F.coalesce("detail", F.lit("")), F.lit(r"([A-Za-z_]+\s*[=:]\s*\d+)"), F.lit(1))
    counts = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.regexp_replace(p, r"\s*[=:]\s*", "="))), ",")
    return t.select("run_id", "ord", "code", "severity", F.coalesce("title", "code").alias("title"), F.coalesce("why", "message").alias("why"), counts.alias("counts"), level.alias("level"), target.alias("target"))


def blockers(issues: DataFrame, steps: DataFrame, report_guides: DataFrame, user_codes: tuple[str, ...] = ()) -> DataFrame:
    """run_id, code and level of what stops automatic repair: steps(run_id, code, severity, level) of codes in error that need
    the user or the environment, and errors without such a step that report_guides(code, level) knows."""
    errors = issues.where("severity = 'error'").select("run_id", "code").distinct()
    stop = F.col("level").startswith("needs_user") | (F.col("level") == "needs_environment") | F.col("code").isin(*user_codes or ("",))
    own = steps.where((F.col("severity") == "error") & stop).join(errors, ["run_id", "code"], "left_semi").select("run_id", "code", "level").distinct()
    rest = errors.join(own, ["run_id", "code"], "left_anti").join(report_guides, "code").select("run_id", "code", "level")
    return own.unionByName(rest)


def stop_reasons(blocked: DataFrame, user_codes: tuple[str, ...] = ()) -> DataFrame:
    """run_id and why its repair stops, by the levels and codes of its blockers(run_id, code, level)."""
    every = lambda test: F.min(F.coalesce(test, F.lit(False)).cast("int")) == 1
    reason = (
        F.when(every(F.col("level") == "needs_environment"), "stopped_dependency_or_environment")
        .when(every(F.col("level") == "needs_user_file") | every(F.col("code").isin(*user_codes or ("",))), "stopped_needs_user_file")
        .otherwise("stopped_needs_user_input")
    )
    return blocked.groupBy("run_id").agg(reason.alias("reason"))


def run_states(issues: DataFrame) -> DataFrame:
    """run_id, passed, errors and warnings (codes in order), and their numbers, over all reports of a run together."""
    codes = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("phase", "ord", "code")))), lambda x: x["code"]), ",")
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return issues.groupBy("run_id").agg((n("error") == 0).alias("passed"), codes("error").alias("error_codes"), codes("warning").alias("warning_codes"), n("error").alias("n_errors"), n("warning").alias("n_warnings"))


def statuses(issues: DataFrame) -> DataFrame:
    """run_id, phase, passed and status of each report: failed by an error, else passed, with warnings if there are any."""
    has = lambda s: F.max((F.col("severity") == s).cast("int")) == 1
    status = F.when(has("error"), "failed").when(has("warning"), "passed_with_warnings").otherwise("passed")
    return issues.groupBy("run_id", "phase").agg((~has("error")).alias("passed"), status.alias("status"))


def unique_names(names: DataFrame) -> DataFrame:
    """names(ord, name) with a name of its own for each row: the second of equal ones gets _2, the third _3."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    return names.withColumn("unique_name", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("_", "name", n.cast("string"))))
