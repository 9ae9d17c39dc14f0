"""Job ledger: attempts, outcomes, history matching, queues and reports.

``attempts`` columns: id, seq (ledger order), source, published_path, state,
created_us, finished_us, size, output_bytes, saved_bytes, batch, reason,
decision_code, outcome, superseded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesleuth.functions.checks import holds
from framesleuth.functions.labels import natural_key, outcome_category, phase_category, report_bucket, report_group
from framesleuth.operators import ordered
from framesleuth.operators.timeline import keep_latest
from framesleuth.session import materialise

ACTIVE = ("pending", "running")


# Latest attempts -----------------------------------------------------------

def history_key(path: Column) -> Column:
    """Path with forward slashes; drive-letter paths ignore case."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.rlike(r"^[A-Za-z]:/"), F.lower(slashed)).otherwise(slashed)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Smallest name reachable from each node of an undirected graph.

    Alternating star contraction: every round points nodes at the smallest
    neighbour by a groupBy/min and an equi-join, so a hub is pre-aggregated
    rather than collected.  Each round's edges are written, cutting lineage; it
    stops when a round changes nothing (the count of pairs and a hash sum).  With
    ``rounds`` it raises if so many were not enough.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        kept = joined.where(F.col("v") > F.col("u")) if larger else joined
        moved = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    current = materialise(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    seen, mark, done = None, (), 0
    while seen != mark:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        seen, done = mark, done + 1
        current = materialise(star(star(current, True), False), "edges")
        mark = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return current.groupBy("u").agg(F.min("v").alias("root"))


def outcome_time(attempts: DataFrame) -> Column:
    """When an attempt ended, else started, else was created; 0 if none is known."""
    known = [F.when(F.col(c) > 0, F.col(c)) for c in ("finished_us", "started_us", "created_us") if c in attempts.columns]
    return F.coalesce(*known, F.lit(0))


def latest_attempts(attempts: DataFrame, ended: Column | None = None) -> DataFrame:
    """Newest attempt of each video; a published path is the same video as the
    source it came from.  Newest = created, then ``ended`` (the outcome time), then id."""
    ended = outcome_time(attempts) if ended is None else ended
    keyed = attempts.withColumn("_key", history_key(F.coalesce(F.nullif("source", F.lit("")), F.col("id").cast("string"))))
    links = keyed.where(F.col("published_path").isNotNull()).select(F.col("_key").alias("u"), history_key(F.col("published_path")).alias("v"))
    roots = components(links).withColumnRenamed("u", "_key")
    grouped = keyed.join(roots, "_key", "left").withColumn("video", F.coalesce("root", "_key")).drop("root", "_key")
    order = F.struct(F.coalesce("created_us", F.lit(0)), ended, F.col("id").cast("string"))
    fields = [c for c in grouped.columns if c != "video"]
    best = grouped.groupBy("video").agg(F.count(F.lit(1)).alias("attempts"), F.max_by(F.struct(*fields), order).alias("_a"))
    return best.select("video", "attempts", *[F.col(f"_a.{c}").alias(c) for c in fields])


def with_category(attempts: DataFrame) -> DataFrame:
    category = outcome_category(F.col("state"), F.col("reason"), F.col("decision_code"), F.col("outcome"))
    return attempts.withColumn("category", category).withColumn("report_group", report_group(F.col("category")))


def outcome_counts(attempts: DataFrame, ended: Column | None = None) -> DataFrame:
    """Videos per outcome, from the latest attempt that was not superseded."""
    latest = latest_attempts(attempts.where(~F.coalesce("superseded", F.lit(False))), ended)
    return with_category(latest).groupBy("category").agg(F.count(F.lit(1)).alias("videos"))


def report_rows(attempts: DataFrame, scope: str = "latest", category: str = "all", text: str = "", ended: Column | None = None) -> DataFrame:
    """Activity report rows filtered by outcome (or report group) and source text."""
    rows = attempts if scope == "attempts" else latest_attempts(attempts.where(~F.coalesce("superseded", F.lit(False))), ended)
    rows = with_category(rows)
    if category != "all":
        field = "report_group" if category in ("converted", "kept", "problems", "active") else "category"
        rows = rows.where(F.col(field) == category)
    return rows.where(F.lower(F.coalesce("source", F.lit(""))).contains(text.lower()))


def result_view(attempts: DataFrame, archived: DataFrame, *, show_archived: bool = False, batch: str = "", group: str = "all", text: str = "", ended: Column | None = None) -> DataFrame:
    """Latest results as the history view shows them.

    Archived rows are hidden unless active; ``batch`` is a batch id or
    ``folder:<parent>``; ``group`` is all, history, replaceable or one result group.
    """
    rows = attempts
    if not show_archived:
        hidden = archived.select("id").distinct().withColumn("_hidden", F.lit(True))
        rows = rows.join(hidden, "id", "left").where(F.col("state").isin(*ACTIVE) | F.col("_hidden").isNull()).drop("_hidden")
    folder = F.regexp_extract(F.replace(F.coalesce("source", F.lit("")), F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)
    rows = rows.withColumn("batch_key", F.coalesce(F.nullif(F.col("batch").cast("string"), F.lit("")), F.concat(F.lit("folder:"), folder)))
    if batch:
        rows = rows.where(F.col("batch_key") == batch)
    latest = latest_attempts(rows, ended).withColumn("result_group", result_group(F.col("state")))
    latest = latest.where(F.lower(F.coalesce("source", F.lit(""))).contains(text.lower()))
    if group == "replaceable":
        return latest.where((F.col("state") == "awaiting-playback") & (F.col("mode") == "encode") & F.coalesce("publication_authorized", F.lit(True)))
    if group == "history":
        return latest
    if group == "all":
        return latest.where((F.col("result_group") != "active") | (F.col("attempts") > 1))
    return latest.where(F.col("result_group") == group)


def result_group(state: Column) -> Column:
    """Group of a result; a state not known to be settled needs attention."""
    return (
        F.when(state.isin(*ACTIVE), "active").when(state.isin("verified", "awaiting-playback", "playback-approved"), "ready").when(state == "replaced", "replaced")
        .when(state.isin("kept-original", "skipped"), "kept").when(state.isin("analyzed", "tested", "completed", "cancelled"), "complete").otherwise("attention")
    )


# Totals --------------------------------------------------------------------

def state_counts(rows: DataFrame, columns: Sequence[str], size: str) -> DataFrame:
    """Counts and bytes by each column and overall, in one pass."""
    sets = [[F.col(c)] for c in columns] + [[]]
    return rows.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.grouping_id().alias("level"))


def queue_size_totals(jobs: DataFrame) -> DataFrame:
    """Known bytes and unknown counts for waiting, running and both together.

    A repeated id counts once; jobs without one are jobs of their own.
    """
    active = jobs.where(F.col("state").isin(*ACTIVE))
    named = active.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct("state", "size"), "seq").alias("j")).select("j.state", "j.size")
    queued = named.unionByName(active.where(F.col("id").isNull()).select("state", "size"))
    return queued.rollup("state").agg(
        F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum(F.when(F.col("size") >= 0, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(~holds(F.col("size") >= 0)).alias("unknown"),
    ).withColumn("state", F.coalesce("state", F.lit("total")))


def savings_summary(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accepted outputs: total bytes and source-weighted percent (basis points)."""
    total = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("source_bytes").alias("source_bytes"), F.sum("output_bytes").alias("output_bytes"))
    saved = F.col("source_bytes") - F.col("output_bytes")
    return total.withColumn("saved_bytes", saved).withColumn(
        "saved_bp", F.when(F.col("source_bytes") > 0, F.call_function("div", saved.cast("decimal(20,0)") * 10_000, F.col("source_bytes"))).otherwise(0)
    )


def batch_savings(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size-weighted percent of validated copies per batch; invalid rows ignored.
    ``savings_bp`` is each copy's saving in basis points."""
    valid = (F.col("status") == "validated-copy") & (F.col("size") > 0) & (F.col("savings_bp") <= 10_000)
    return rows.where(holds(valid)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.call_function("div", F.sum(F.col("size").cast("decimal(20,0)") * F.col("savings_bp")), F.sum("size")).alias("percent_bp"),
    )


def lifetime_savings(attempts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Confirmed reductions: replaced jobs and valid manual receipts, each request
    once with the job taking precedence."""
    jobs = attempts.where(F.col("state") == "replaced").select(
        F.col("id").cast("string").alias("request"), F.lit(0).alias("rank"), F.coalesce("size", F.lit(0)).alias("original"), F.coalesce("saved_bytes", F.lit(0)).alias("saved")
    )
    good = F.col("original_removed") & F.col("output_sha256").rlike("^.{64}$") & (F.col("old_bytes") > F.col("new_bytes")) & (F.col("new_bytes") > 0)
    manual = receipts.where(holds(good)).select(
        F.col("request").cast("string").alias("request"), F.lit(1).alias("rank"), F.col("old_bytes").alias("original"), (F.col("old_bytes") - F.col("new_bytes")).alias("saved")
    )
    # Ledger ids are unique and a request has one receipt; the smaller rank wins.
    one = jobs.unionByName(manual).groupBy("request").agg(F.min_by(F.struct("original", "saved"), "rank").alias("e"))
    return one.agg(F.count(F.lit(1)).alias("replaced_files"), F.coalesce(F.sum("e.original"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("e.saved"), F.lit(0)).alias("saved_bytes"))


# History -------------------------------------------------------------------

MEASURED_SETTINGS = ("codec", "hardware", "quality", "minimum_savings", "savings_mode", "codecs", "legacy_color")
OUTPUT_DEFAULTS = {"output_preset": "original", "hdr_policy": "preserve", "quality_profile": None}


def _ledger_identity(ledger: DataFrame) -> DataFrame:
    replaced = F.col("state") == "replaced"
    return ledger.withColumns({
        "path": F.when(replaced, F.col("published_path")).otherwise(F.col("source")),
        "stamp": F.when(replaced, F.col("published_signature")).otherwise(F.col("signature")),
    })


def history_match(files: DataFrame, ledger: DataFrame, settings: dict, policy: str, version: str) -> DataFrame:
    """Files beside the newest ledger record that protects them, if any.

    ``files``: path, stamp.  ``ledger`` adds signature, published_signature,
    settings map, history_decision, evaluation_policy, app_version.  Automatic
    conclusions hold only for the same measured policy and settings.
    """
    rows = _ledger_identity(ledger)
    given = lambda key: F.lit(settings.get(key)).cast("string")
    theirs = lambda key: F.element_at("settings", F.lit(key))
    reason = F.coalesce("reason", F.lit(""))
    unsupported, too_big = reason.startswith("Unsupported input:"), reason.startswith("Full output did not save enough space")
    decided = F.coalesce("history_decision", F.lit(False))
    concluded = decided | F.coalesce(F.col("decision_code") == "already_efficient_for_settings", F.lit(False)) | unsupported | too_big
    same_measured = F.coalesce(F.col("evaluation_policy") == policy, F.lit(False))
    for key in MEASURED_SETTINGS:
        same_measured = same_measured & theirs(key).eqNullSafe(given(key))
    same_output = F.lit(True)
    for key, default in OUTPUT_DEFAULTS.items():
        wanted = F.lit(settings.get(key, default)).cast("string")
        same_output = same_output & F.coalesce(theirs(key), F.lit(default).cast("string")).eqNullSafe(wanted)
    state = F.col("state")
    active = state.isin(*ACTIVE)
    void = (
        ((state == "skipped") & concluded & ~same_measured) | (~state.isin("kept-original", "replaced") & ~same_output)
        | ((state == "skipped") & unsupported & ~F.coalesce(F.col("app_version") == version, F.lit(False))) | F.lit(bool(settings.get("recheck")))
    )
    stands = (
        state.isin("kept-original", "replaced") | ((state == "awaiting-playback") & F.lit(settings.get("mode") != "replace"))
        | ((state == "skipped") & (decided | unsupported | too_big)) | (state.isin("analyzed", "tested") & (theirs("mode") == given("mode")))
    )
    protecting = rows.where(active | (~void & holds(stands)))
    newest = protecting.groupBy("path", "stamp").agg(F.max_by(F.struct("id", "state"), "seq").alias("_p"))
    return files.join(newest, ["path", "stamp"], "left").select(
        *files.columns, F.col("_p.id").alias("protected_by"), F.col("_p.state").alias("protected_state")
    )


def unprocessed(files: DataFrame, ledger: DataFrame, settings: dict, policy: str, version: str) -> DataFrame:
    """Files no record protects."""
    return history_match(files, ledger, settings, policy, version).where(F.col("protected_by").isNull()).select(*files.columns)


def retry_match(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Retry-only mode: a file qualifies when its newest record of this version
    failed, was skipped, cancelled or interrupted, and no active claim or
    successful result protects it."""
    rows = ledger.withColumn("path", F.explode(F.array_distinct(F.array_compact(F.array("source", "published_path")))))
    wanted = files.select("path", "stamp")
    done = F.col("state").isin("replaced", "awaiting-playback", "kept-original")
    mark = F.when(F.col("state") == "replaced", F.col("published_signature")).otherwise(F.col("signature"))
    related = rows.select("path", "id", "seq", "state", "signature", mark.alias("_mark"), done.alias("_done"))
    claims = related.where(F.col("state").isin(*ACTIVE)).groupBy("path").agg(F.max(F.struct("seq", "id")).alias("_c"))
    kept = related.where("_done").groupBy("path", F.col("_mark").alias("stamp")).agg(F.max(F.struct("seq", "id")).alias("_k"))
    last = related.groupBy("path", F.col("signature").alias("stamp")).agg(F.max_by("state", "seq").alias("last_state"))
    joined = wanted.join(claims, "path", "left").join(kept, ["path", "stamp"], "left").join(last, ["path", "stamp"], "left")
    best = F.greatest(F.col("_c"), F.col("_k"))
    again = F.col("last_state").isin("skipped", "failed", "interrupted", "cancelled")
    return joined.select(
        "path", "stamp", best["id"].alias("protected_by"),
        F.when(best.isNotNull(), "protected").when(holds(again), "retry").otherwise("not-selected").alias("decision"),
    )


def unseen_content(files: DataFrame, known: DataFrame, digest: str = "digest") -> DataFrame:
    """One file per content not evaluated before: the smallest id of each digest."""
    fresh = files.join(known.select(digest).distinct(), digest, "left_anti")
    return fresh.groupBy(digest).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


# Joins to telemetry, batches and directories -------------------------------

def with_latest_telemetry(requests: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Each request beside the newest telemetry record whose directory names it.

    Records of ``job-`` directories win over others; newest is by ``updated``,
    or ``started`` where that is unknown.
    """
    slashed = F.replace("directory", F.lit("\\"), F.lit("/"))
    extracted = telemetry.withColumn("id", F.nullif(F.regexp_extract(slashed, r"request-([^/]+)(?:/|$)", 1), F.lit("")))
    times = [F.when(F.col(c) > 0, F.col(c)) for c in ("updated", "started") if c in telemetry.columns]
    order = F.struct(slashed.rlike(r"/job-[^/]+$"), F.coalesce(*times, F.lit(0)), "directory")
    newest = extracted.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("phase", "percent", "updated"), order).alias("t"))
    return requests.join(newest, "id", "left").select(*requests.columns, "t.phase", "t.percent", "t.updated")


def _json_text(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def review_key(source: Column, output: Column) -> Column:
    """Identity of a reviewed output: SHA-256 of the JSON pair."""
    return F.sha2(F.concat(F.lit("["), _json_text(source), F.lit(", "), _json_text(output), F.lit("]")), 256)


def batch_rows(rows: DataFrame, results: DataFrame, receipts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Batch entries with sizes from result, receipt or the entry itself, and the
    playback reviews recorded for that exact output."""
    r = results.select("output", F.struct("source_bytes", "output_bytes").alias("r"))
    c = receipts.select("output", F.struct("source_bytes", "output_bytes").alias("c"))
    keyed = rows.withColumn("review_id", review_key(F.col("source"), F.col("output"))).join(r, "output", "left").join(c, "output", "left")
    # Clients are a fixed short list, one review each: newest wins per client.
    per_client = reviews.groupBy("review_id", "client").agg(F.max_by("status", "updated").alias("status"))
    playback = per_client.groupBy("review_id").pivot("client", ["Chrome", "Dolby Vision-capable TV", "Plex"]).agg(F.first("status"))
    shown = [F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(n + ": "), F.col(f"`{n}`"))) for n in ("Chrome", "Dolby Vision-capable TV", "Plex")]
    evidence = F.coalesce("r", "c")
    verification = (
        F.when(F.col("state").isin("verified_pending_playback", "verified-awaiting-playback", "resumed-verified"), "Passed")
        .when(F.col("state").contains("fail"), "Failed").otherwise("Pending")
    )
    joined = keyed.join(playback, "review_id", "left")
    return joined.select(
        "source", "output", "state", "review_id", F.coalesce(evidence["source_bytes"], "size").alias("original_bytes"),
        F.coalesce(evidence["output_bytes"], "entry_output_bytes").alias("output_bytes"), verification.alias("verification"),
        F.coalesce(F.nullif(F.concat_ws(" · ", *shown), F.lit("")), F.lit("Not recorded")).alias("playback"),
    )


def uncovered_directories(untracked: DataFrame, linked: DataFrame) -> DataFrame:
    """Untracked directories that are not inside (or equal to) a linked run."""
    parts = F.split("directory", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    covered = untracked.select("directory", F.explode(prefixes).alias("run")).join(linked.select(F.col("directory").alias("run")).distinct(), "run", "left_semi")
    return untracked.join(covered.select("directory").distinct(), "directory", "left_anti")


def owned_processes(processes: DataFrame, table: DataFrame, owner: int, namespace: str, keys: Sequence[str] = ()) -> DataFrame:
    """Does each process descend from the owner?  ``owned`` is NULL when unknown.

    ``processes``: pid, namespace, start_ticks; ``table``: the process table with
    pid, parent, start_ticks.  ``keys`` name columns of both that tell tables apart
    (a host, a time).  Parent links are doubled every round, so a chain of n needs
    log2(n) joins and a cycle ends after log2(table size).
    """
    keys = list(keys)
    # A link back to the process itself leads nowhere, so it ends the chain.
    onward = lambda link: F.when(link == F.col("pid"), 0).otherwise(link)
    current = materialise(table.select(*keys, "pid", onward(F.col("parent")).alias("jump"), (F.col("pid") == owner).alias("hit"), F.lit(False).alias("lost")), "jumps")
    n = max(2, current.count())
    for _ in range(math.ceil(math.log2(n)) + 1):
        ahead = current.select(*keys, F.col("pid").alias("jump"), F.col("jump").alias("_next"), F.col("hit").alias("_hit"), F.col("lost").alias("_lost"), F.lit(True).alias("_known"))
        open_link = ~F.col("hit") & ~F.col("lost") & (F.col("jump") != 0)
        # Settled rows carry a NULL key, so they neither match nor pile up on one.
        moved = current.withColumn("jump", F.when(open_link, F.col("jump"))).join(ahead, [*keys, "jump"], "left")
        live = F.col("jump").isNotNull()
        # A link to the owner itself counts even if the owner's record is gone.
        found = F.col("hit") | holds(F.col("jump") == owner) | F.coalesce("_hit", F.lit(False))
        current = materialise(
            moved.select(
                *keys, "pid", onward(F.when(live & F.col("_known").isNotNull(), F.col("_next")).otherwise(0)).alias("jump"), found.alias("hit"),
                (~found & (F.col("lost") | (live & F.col("_known").isNull()) | F.coalesce("_lost", F.lit(False)))).alias("lost"),
            ), "jumps",
        )
        if current.where(~F.col("hit") & ~F.col("lost") & (F.col("jump") != 0)).isEmpty():
            break
    chains = current.select(*keys, "pid", "hit", "lost").join(table.select(*keys, "pid", F.col("start_ticks").alias("_ticks")), [*keys, "pid"])
    rows = processes.join(chains, [*keys, "pid"], "left")
    owned = (
        F.when(F.col("namespace").isNull(), None).when(F.col("namespace") != namespace, False)
        .when(F.col("hit").isNull() | ~F.col("_ticks").eqNullSafe(F.col("start_ticks")), None).when(F.col("hit"), True).when(F.col("lost"), None).otherwise(False)
    )
    return rows.select(*processes.columns, owned.alias("owned"))


def choice_report(trials: DataFrame, assessed: DataFrame, timings: DataFrame, selected: DataFrame) -> DataFrame:
    """Options of each report beside their assessment and measured time."""
    # Wording of each assessment.
    words = {
        "eligible": "Passed; another option was preferred", "speed_screened": "Did not show enough speed benefit", "size_screened": "Did not save enough space",
        "insufficient_savings": "Did not save enough space", "quality_rejected": "Did not meet the quality target", "inconclusive": "Checks incomplete",
    }
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    a = assessed.select("report", "trial", "assessment", "savings_bp")
    t = timings.select("report", "trial", F.col("measured_ms").alias("encode_ms"))
    chosen = selected.select("report", F.col("selected").alias("trial"), F.lit(True).alias("chosen"))
    rows = trials.join(a, ["report", "trial"], "left").join(t, ["report", "trial"], "left").join(chosen, ["report", "trial"], "left")
    outcome = F.when(F.col("chosen").isNotNull(), "Selected").otherwise(F.coalesce(F.element_at(table, F.col("assessment")), F.lit("Checks incomplete")))
    return rows.select(
        "report", "trial", "codec", "encoder", "settings", F.coalesce("chosen", F.lit(False)).alias("selected"), outcome.alias("outcome"), "savings_bp", "encode_ms"
    )


# Time and throughput -------------------------------------------------------

def time_report(records: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Stage time shares per job, refused where the records cannot be combined.

    ``records``: job, record, started, finished (ms), schema, seconds
    map<category, ms> and, for records still running, ``updated``, which stands
    for the end they do not have.  Refused when a record is incomplete, older than
    schema 3, overlaps the previous one, or measures more than its window plus 2 s.
    """
    if "updated" in records.columns:
        records = records.withColumn("finished", F.coalesce("finished", "updated")).drop("updated")
    spent = F.aggregate(F.map_values("seconds"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    shaped = records.withColumn("_spent", spent)
    placed = ordered.number_rows(shaped.withColumn("_s", F.coalesce("started", F.lit(0))), ["job"], ["_s", "record"])
    rows = ordered.scan(placed, ["job"], "ordinal", block_rows, previous_end=ordered.lag(F.col("finished")))
    bad_value = F.exists(F.map_values("seconds"), lambda x: x.isNull() | (x < 0))
    broken = (
        ~holds((F.col("started") >= 0) & (F.col("finished") >= F.col("started")) & (F.size("seconds") > 0) & ~bad_value & (F.col("schema") >= 3))
        | holds(F.col("started") < F.col("previous_end"))
    )
    over = holds(F.col("_spent") > F.col("finished") - F.col("started") + 2000)
    # The first bad record decides; a broken one outranks an overlong one.
    verdict = rows.groupBy("job").agg(
        F.min(F.when(broken, F.col("ordinal") * 2).when(over, F.col("ordinal") * 2 + 1)).alias("_bad"), F.sum("_spent").alias("total_ms"), F.count(F.lit(1)).alias("records")
    )
    reason = (
        F.when(F.col("_bad") % 2 == 0, "records are incomplete or overlap").when(F.col("_bad").isNotNull(), "recorded times exceed their window")
        .when(F.col("total_ms") <= 0, "no measured stage times")
    )
    verdict = verdict.select("job", "records", "total_ms", reason.alias("reason"))
    stages = records.select("job", F.explode("seconds").alias("category", "ms")).groupBy("job", report_bucket(F.col("category")).alias("bucket")).agg(F.sum("ms").alias("ms"))
    good = stages.join(verdict.where(F.col("reason").isNull()), "job").select(
        "job", "records", "bucket", "ms", F.call_function("div", F.col("ms") * 10_000, F.col("total_ms")).alias("share_bp"), F.lit(None).cast("string").alias("reason")
    )
    none = F.lit(None)
    refused = verdict.where(F.col("reason").isNotNull()).select("job", "records", none.cast("string").alias("bucket"), none.cast("long").alias("ms"), none.cast("long").alias("share_bp"), "reason")
    return good.unionByName(refused)


def stage_seconds(heartbeats: DataFrame, key: str = "job", block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Time between neighbouring heartbeats, charged to the earlier one's phase.
    ``heartbeats``: job, ordinal, at_us, phase."""
    rows = ordered.scan(heartbeats, [key], "ordinal", block_rows, following=ordered.lead(F.col("at_us")))
    spent = F.greatest(F.lit(0), F.col("following") - F.col("at_us"))
    return rows.where(F.col("following").isNotNull()).groupBy(key, phase_category(F.col("phase")).alias("category")).agg(F.sum(spent).alias("us"), F.count(F.lit(1)).alias("intervals"))


def throughput_gain(samples: DataFrame, key: str = "family") -> DataFrame:
    """2 * median(paired) / median(single) over the last eight of each kind.

    ``samples``: family, ordinal, work, elapsed, overlap (0..1).  Slightly
    overlapping samples (0 < overlap < 0.8) and those under two seconds are
    discarded; three of each kind are needed and 1.10 promotes.
    """
    usable = samples.where((F.col("work") > 0) & (F.col("elapsed") >= 2) & (F.col("overlap") <= 1) & ((F.col("overlap") <= 0) | (F.col("overlap") >= 0.8)))
    rated = usable.select(key, "ordinal", (F.col("work") / F.col("elapsed")).alias("rate"), (F.col("overlap") >= 0.8).alias("paired"))
    last = keep_latest(rated, [key, "paired"], [F.desc("ordinal")], 8)
    medians = last.groupBy(key).agg(
        F.count_if("paired").alias("paired"), F.count_if(~F.col("paired")).alias("single"),
        F.median(F.when(F.col("paired"), F.col("rate"))).alias("_p"), F.median(F.when(~F.col("paired"), F.col("rate"))).alias("_s"),
    )
    enough = (F.col("paired") >= 3) & (F.col("single") >= 3)
    gain = F.when(enough, 2 * F.col("_p") / F.col("_s"))
    return medians.select(key, "paired", "single", gain.alias("gain"), F.when(holds(gain >= 1.10), "parallel").otherwise("serial").alias("mode"))


def latest_report(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """Newest validation report of each directory, and whether the review approves
    exactly that report.  ``reports``: directory, name, finished, status."""
    newest = reports.where(F.col("finished").isNotNull()).groupBy("directory").agg(F.max_by(F.struct("name", "status", "finished"), F.struct("finished", "name")).alias("r"))
    rows = newest.select("directory", "r.*").join(reviews.select("directory", "approved", "validation_report"), "directory", "left")
    verified = F.col("status").startswith("verified")
    approved = holds(F.col("approved") & (F.col("validation_report") == F.col("name")) & verified)
    state = F.when(approved, "playback-approved").when(verified, "verified").otherwise(F.col("status"))
    return rows.select("directory", "name", "finished", approved.alias("approved"), state.alias("state"), (~approved & F.col("status").contains("awaiting")).alias("awaiting_playback"))


#: States of a status file without a report, and what they say: fixed values.
STATUS_STATES = {"validated-copy-awaiting-playback": "verified-awaiting-playback", "stopped-original-retained": "failed", "full-output-rejected-insufficient-savings": "skipped"}


def latest_outcome(reports: DataFrame, reviews: DataFrame, statuses: DataFrame) -> DataFrame:
    """As ``latest_report``, with the file's time where a report has no ``finished`` and
    the status file where a directory has no report.

    ``reports`` has ``mtime`` too; ``statuses``: directory, state, action, reason, error.
    A status of completed trials is ``skipped`` if it keeps the original, else ``completed``.
    """
    dated = reports.withColumn("finished", F.coalesce("finished", "mtime")).drop("mtime")
    found = latest_report(dated, reviews).withColumn("detail", F.lit(None).cast("string"))
    state = F.when(F.col("state") == "trials-completed", F.when(holds(F.col("action") == "keep_original"), "skipped").otherwise("completed"))
    for name, meaning in STATUS_STATES.items():
        state = state.when(F.col("state") == name, meaning)
    stopped = F.col("state").isin("stopped-original-retained", "full-output-rejected-insufficient-savings")
    detail = F.when(F.col("state") == "trials-completed", F.col("reason")).when(stopped, F.coalesce("error", "state"))
    rest = statuses.join(dated.where("finished IS NOT NULL").select("directory").distinct(), "directory", "left_anti")
    none = F.lit(None)
    rest = rest.select(
        "directory", none.cast("string").alias("name"), none.cast("long").alias("finished"), F.lit(False).alias("approved"), state.alias("state"),
        (state == "verified-awaiting-playback").alias("awaiting_playback"), detail.alias("detail"),
    )
    return found.unionByName(rest.where("state IS NOT NULL"))


# Orders and pages ----------------------------------------------------------

def waiting_order(jobs: DataFrame, order: str = "added") -> DataFrame:
    """Pending jobs in the chosen order; unknown values last, ties keep ledger order."""
    waiting = jobs.where(F.col("state") == "pending")
    name = F.lower(F.regexp_extract(F.replace(F.col("source"), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    keys = {
        "added": [], "name": [F.coalesce(F.nullif(name, F.lit("")), F.lit(None).cast("string")).asc_nulls_last()],
        "modified-newest": [F.col("mtime").desc_nulls_last()], "modified-oldest": [F.col("mtime").asc_nulls_last()],
        "size-largest": [F.when(F.col("size") >= 0, F.col("size")).desc_nulls_last()], "size-smallest": [F.when(F.col("size") >= 0, F.col("size")).asc_nulls_last()],
    }
    return waiting.orderBy(*keys[order], F.col("seq"))


def next_pending(jobs: DataFrame, order: str = "added") -> DataFrame:
    return waiting_order(jobs, order).limit(1)


def result_keys(rows: DataFrame, mode: str = "newest") -> list[tuple[Column, bool]]:
    """Keys of the result list, each with whether it descends: by mode, then newest first, name and id.

    Unknown times come last in either direction; only a replaced result saved.
    """
    at = outcome_time(rows)
    name = natural_key(F.regexp_extract(F.replace(F.coalesce("source", F.lit("Video")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    ties = [(at, True), (name, False), (F.col("id").cast("string"), False)]
    first = {"newest": [], "oldest": [(F.nullif(at, F.lit(0)), False)], "name": [(name, False)], "saved": [(F.when(F.col("state") == "replaced", F.col("saved_bytes")), True)]}
    return [*first[mode], *ties]


def result_order(rows: DataFrame, mode: str = "newest") -> list[Column]:
    return [key.desc_nulls_last() if down else key.asc_nulls_last() for key, down in result_keys(rows, mode)]


def sort_results(rows: DataFrame, mode: str = "newest") -> DataFrame:
    return rows.orderBy(*result_order(rows, mode))


def page(rows: DataFrame, order: Sequence[Column], offset: int, size: int = 100) -> DataFrame:
    """One page in order, with its position and the next offset (NULL at the end).

    One row more than the page tells whether another page follows; both are
    limits, so only offset + size + 1 rows are ever kept.
    """
    chunk = rows.orderBy(*order).offset(offset).limit(size + 1)
    numbered = chunk.withColumn("position", F.row_number().over(Window.orderBy(*order)) + offset)
    more = F.max("position").over(Window.partitionBy()) > offset + size
    return numbered.withColumn("next_offset", F.when(more, F.lit(offset + size))).where(F.col("position") <= offset + size)


def listing(entries: DataFrame, offset: int = 0, size: int = 100) -> DataFrame:
    """Directory listing: folders first, then case-folded names."""
    return page(entries, [F.col("directory").desc(), F.lower("name").asc(), F.col("name").asc()], offset, size)


def inventory_rows(rows: DataFrame, action: str = "", text: str = "", offset: int = 0, size: int = 100) -> DataFrame:
    """One page of an inventory filtered by action and path text, beside the
    number of matching and scanned rows."""
    matching = F.lit(True) if not action else F.col("action") == action
    matching = matching & F.lower(F.coalesce("path", F.lit(""))).contains(text.lower())
    totals = rows.agg(F.count_if(holds(matching)).alias("total"), F.count(F.lit(1)).alias("scanned"))
    shown = page(rows.where(matching), [F.col("id").asc()], offset, size)
    return shown.crossJoin(F.broadcast(totals))  # totals is a single row


def waiting_rank(tickets: DataFrame, now: Column) -> DataFrame:
    """Ticket order: waiters of 30 s or more first, then short work, then the rest;
    unknown evidence keeps its place among the first.

    ``tickets``: sequence, started, seconds, final; times in seconds.
    """
    age = now - F.col("started")
    unknown = ~holds(age >= 0)
    short = holds((F.col("seconds") > 0) & (F.col("seconds") <= 60))
    rank = F.when(unknown | (age >= 30), -1)
    return tickets.select(
        "*", rank.when(short, 0).otherwise(1).alias("rank"), rank.when(holds(F.col("final")), 0).otherwise(1).alias("final_rank")
    ).orderBy("rank", "sequence")


def two_bypass_choice(tickets: DataFrame) -> DataFrame:
    """Next ticket when at most two short admissions may pass a waiting long one."""
    valid = holds((F.col("seconds") > 0) & F.coalesce(F.col("bypasses"), F.lit(0)).between(0, 2))
    forced = holds((F.col("seconds") > 60) & (F.coalesce("bypasses", F.lit(0)) >= 2))
    picks = tickets.agg(
        F.count_if(~valid).alias("odd"), F.min("sequence").alias("first"), F.min(F.when(forced, F.col("sequence"))).alias("forced"),
        F.min(F.when(F.col("seconds") <= 60, F.col("sequence"))).alias("short"),
    )
    return picks.select(F.when(F.col("odd") > 0, F.col("first")).otherwise(F.coalesce("forced", "short", "first")).alias("sequence"))


def catalog_order(jobs: DataFrame) -> DataFrame:
    """Running jobs first, then most recently started (or updated)."""
    return jobs.orderBy((F.col("state") == "running").desc(), F.coalesce("started_us", "updated_us").desc(), F.col("id"))


# Set operations ------------------------------------------------------------

def archive(jobs: DataFrame, archived: DataFrame) -> DataFrame:
    """Archive every finished job: the new archive, marking what undo would remove."""
    current = jobs.where(~F.col("state").isin(*ACTIVE)).select("id").distinct()
    added = current.join(archived, "id", "left_anti")
    return archived.select("id").distinct().withColumn("undo", F.lit(False)).unionByName(added.withColumn("undo", F.lit(True)))


def undo_archive(archived: DataFrame) -> DataFrame:
    return archived.where(~F.col("undo")).select("id")


def cancelled_scope(jobs: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """Ids restored together: the recorded cancellation, else the batch of the
    newest cancelled job (or that job alone).

    ``recorded``: id, scope_created_us of the last recorded cancellation.
    """
    at = F.coalesce("cancel_requested_us", "finished_us", "created_us", F.lit(0))
    rows = jobs.where((F.col("state") == "cancelled") & F.col("source").isNotNull() & ~F.coalesce("removed", F.lit(False))).withColumn("_at", at)
    newest = rows.agg(F.max(F.struct("_at", F.negative("seq").alias("s"), "id", "batch")).alias("n")).select("n.*")
    legacy = rows.crossJoin(F.broadcast(newest.select(F.col("batch").alias("_b"), F.col("id").alias("_i")))).where(
        F.when(F.col("_b").isNotNull(), F.col("batch") == F.col("_b")).otherwise(F.col("id") == F.col("_i"))
    ).select("id")
    if recorded is None:
        return legacy
    facts = recorded.agg(F.max("scope_created_us").alias("made")).crossJoin(F.broadcast(newest.select(F.col("_at").alias("at"), F.col("id").alias("_i"))))
    named = recorded.select(F.col("id").alias("_i"), F.lit(True).alias("_in")).distinct()
    use = facts.join(named, "_i", "left").select((F.coalesce("_in", F.lit(False)) | (F.col("at") <= F.col("made"))).alias("use"))
    chosen = recorded.select("id").crossJoin(F.broadcast(use)).where(F.coalesce("use", F.lit(False))).select("id")
    other = legacy.crossJoin(F.broadcast(use)).where(~F.coalesce("use", F.lit(False))).select("id")
    return chosen.unionByName(other)


def restartable(jobs: DataFrame, scope: DataFrame) -> DataFrame:
    """Cancelled jobs of the scope that are still their source's newest attempt."""
    newest = jobs.where(F.col("source").isNotNull()).groupBy("source").agg(F.max_by("id", "seq").alias("id"))
    rows = jobs.where((F.col("state") == "cancelled") & ~F.coalesce("removed", F.lit(False)) & F.col("restarted_as").isNull())
    return rows.join(scope.select("id").distinct(), "id", "left_semi").join(newest, ["id", "source"], "left_semi")


def requeue_interrupted(jobs: DataFrame) -> DataFrame:
    """Decision for every job whose restart was requested.

    Requests are settled in ledger order and a source may have one owner: a
    request is requeued when no other active job owns the source, no later
    request of the source is still running, and none before it was requeued.
    That is the first unblocked request at or after the last running one, so
    three aggregates per source replace the walk.
    """
    asked, dropped = holds(F.col("restart_requested")), holds(F.col("cancel_requested")) | (F.col("state") == "cancelled")
    eligible = asked & ~dropped & F.col("state").isin("running", "interrupted")
    running, publishing = F.col("state") == "running", holds(F.col("publishing"))
    marked = jobs.select("id", "seq", "source", "state", asked.alias("_asked"), dropped.alias("_dropped"), eligible.alias("_eligible"), (eligible & running).alias("_running"), publishing.alias("_publishing"))
    owner = F.col("state").isin(*ACTIVE) & ~F.col("_running")
    facts = marked.groupBy("source").agg(F.count_if(owner).alias("owners"), F.max(F.when(F.col("_running"), F.col("seq"))).alias("last_running"))
    rows = marked.where("_asked").join(facts, "source")
    can = F.col("_eligible") & ~F.col("_publishing") & (F.col("owners") == 0) & (F.col("seq") >= F.coalesce("last_running", F.col("seq")))
    winner = rows.where(can).groupBy("source").agg(F.min("seq").alias("winner"))
    rows = rows.join(winner, "source", "left")
    decision = (
        F.when(F.col("_dropped"), "cancelled").when(~F.col("_eligible"), "finished-before-restart").when(F.col("_publishing"), "blocked: publication must be reconciled")
        .when(holds(F.col("seq") == F.col("winner")), "requeued").otherwise("blocked: another request owns this source")
    )
    return rows.select("id", "source", decision.alias("decision"))


def requeued_jobs(jobs: DataFrame) -> DataFrame:
    """Ledger with interrupted originals and one new pending row per requeued job."""
    again = requeue_interrupted(jobs).where(F.col("decision") == "requeued").select("id", F.lit(True).alias("_again"))
    marked = jobs.join(again, "id", "left")
    kept = marked.withColumn("state", F.when(F.col("_again"), "interrupted").otherwise(F.col("state"))).withColumn("retry_of", F.lit(None).cast("long"))
    fresh = marked.where(F.col("_again")).withColumns({"retry_of": F.col("id").cast("long"), "id": -F.col("id"), "state": F.lit("pending")})
    return kept.unionByName(fresh).drop("_again")
