"""Small relational rules: selections, policies, identities, votes, reports.

Each rule is an expression or a frame of built-in operators; rule tables are dimensions of
fixed size and are joined by their keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_name

# Fixed values.
KIND_ALIASES = {"hero": "hero", "heroes": "hero", "item": "item", "items": "item"}
FULL_ENSEMBLE_FIELDS = ("consecutive_kills", "crowd_control", "healing_and_shields", "jungle_gold", "jungle_gold_percent", "turret_damage")
FULL_ENSEMBLE_PARSERS = ("battle_id", "battle_id_18", "datetime", "level")
FAST_BACKEND, SLOW_BACKEND = "rapidocr-onnxruntime", "tesseract"
SLOW_VARIANTS, RIGHT_EDGE_VARIANTS = ("cubic3x", "clahe3x"), ("right80-native", "right80-cubic3x")
PROFILES = ("exact-cpu", "fast-cpu", "fast-cpu-vectorized", "nvidia-cuda")
SPECIAL_FIELDS = {"game_result": "result_vote", "game_duration": "duration", "hero_level": "level_vote", "total_gold": "gold_vote", "battle_id": "identifier_vote", "match_id": "identifier_vote"}
BALANCED_CHANNELS = ("aligned_gray_correlation", "color_correlation", "histogram_correlation", "edge_correlation")
VOLATILE_KEYS = ("screenshot_path", "timestamp", "processing_time_seconds", "mapping_file")
WARNING_MARKERS = ("floryn", "seven_item", "flower_of_hope")
PLACEHOLDERS = ("placeholder", "unknown", "test", "todo", "tbd", "sample", "dummy", "empty slot")


def enabled_fields(fields: DataFrame) -> DataFrame:
    """Fields that are switched on (P10)."""
    return fields.where("enabled")


def only_kinds(crops: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    """Crops of the wanted kinds, filtered before anything reads their pixels."""
    return crops if kinds is None else crops.where(F.col("kind").isin(*kinds))


def kind_of(text: Column) -> Column:
    """hero or item by any of their names in any case; null for others."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low == alias, kind) for alias, kind in KIND_ALIASES.items()])


def without_visuals(references: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """References without the excluded visuals; an error if none is left."""
    left = references.join(excluded.select(key).distinct(), key, "left_anti")
    if left.isEmpty():
        raise ValueError("reference exclusion cannot remove every visual reference")
    return left


def runtime_profile(requested: Column, has_cuda: Column) -> Column:
    """What a requested profile resolves to (P18): selected, provider, threads, backend,
    status.  Automatic choice takes a certified profile only; an unknown one, or a device
    that is not there, is blocked."""
    name = F.lower(requested)
    selected = F.when(name == "auto", "fast-cpu-vectorized").when(name.isin(*PROFILES), name)
    cuda = selected == "nvidia-cuda"
    fast = selected.isin("fast-cpu", "fast-cpu-vectorized")
    status = F.when(selected.isNull(), "unknown_profile").when(cuda & ~has_cuda, "provider_unavailable").when(cuda, "uncertified").otherwise("ok")
    return F.struct(
        selected.alias("selected"),
        F.when(cuda, "CUDAExecutionProvider").when(selected.isNotNull(), "CPUExecutionProvider").alias("provider"),
        F.when(fast, F.lit(1)).alias("threads"),
        F.when(selected == "fast-cpu-vectorized", "vectorized").when(selected.isNotNull(), "scalar").alias("backend"),
        status.alias("status"),
    )


def truth_required(kind: Column, scope: Column) -> Column:
    """Whether a record needs truth: items do not in a review of exceptions."""
    return (kind == "hero") | (scope != "hero_plus_item_exceptions")


def by_precedence(*values: Column) -> Column:
    """The first value that is given and not empty."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def complete_captures(captures: DataFrame, family: str | None = None, game: str | None = None) -> DataFrame:
    """Complete captures of a family or game, if asked for."""
    rows = captures.where("complete")
    rows = rows if family is None else rows.where(F.col("family") == family)
    return rows if game is None else rows.where(F.col("game") == game)


def bootstrap_box(box: Column, factor: float = 1.2) -> Column:
    """A profile's box or steps at another size, four decimals."""
    return F.transform(box, lambda x: F.bround(x * factor, 4))


def field_route(kind: Column, field: Column) -> Column:
    """Which reader takes a field, and the most it may read (P29, F46): names with a reader of
    their own first, else the kind's; kills, deaths and assists up to 99, other levels to 20."""
    special = F.coalesce(*[F.when(field == name, rule) for name, rule in SPECIAL_FIELDS.items()])
    general = F.when(kind == "integer", "integer").when(kind == "float", "float").when(kind == "percentage", "percentage").otherwise("text")
    most = F.when(field.rlike("kills|deaths|assists"), 99).when(field.contains("level"), 20)
    return F.struct(F.coalesce(special, general).alias("route"), F.when(special.isNull() & (kind == "integer"), most).alias("max_value"))


def hero_accept(identity: Column, name: Column, confidence: Column) -> Column:
    """The older engine's hero: over 0.3 as matched, else none at confidence 0."""
    ok = F.coalesce(confidence > 0.3, F.lit(False))
    return F.struct(F.when(ok, identity).alias("hero_id"), F.when(ok, name).alias("hero_name"), F.when(ok, F.bround(confidence, 3)).otherwise(0.0).alias("confidence"), F.when(~ok, "No match found or confidence too low").alias("error"))


def item_accept(name: Column, confidence: Column) -> Column:
    """The older engine's item: no match and the empty mark are empty slots."""
    empty = name.isNull() | (name == "EMPTY")
    return F.struct(F.when(~empty, name).alias("item_name"), F.when(empty, 0.0).otherwise(F.bround(confidence, 3)).alias("confidence"), empty.alias("is_empty"))


def truth_identity(engine: Column, kind: str, stable_id: Column, legacy: Column) -> Column:
    """The id that an engine is expected to give: the older engine's own where known."""
    own = F.concat(F.lit("v1-hero-"), F.lpad(legacy.cast("string"), F.greatest(F.lit(3), F.length(legacy.cast("string"))), F.lit("0"))) if kind == "hero" else F.concat(F.lit("v1-item:"), legacy)
    return F.when((engine == "legacy-v1") & legacy.isNotNull(), own).otherwise(stable_id)


def reading_plan(backend: Column, variant: Column, field: Column, parser: Column, fast_available: Column) -> Column:
    """Whether a reading of a view by a backend is made (P23): some fields and parsers get
    every view; others, where the fast backend is there, its first view alone, and percentages
    the views of the right edge too; the slow backend reads two views."""
    full = parser.isin(*FULL_ENSEMBLE_PARSERS) | field.isin(*FULL_ENSEMBLE_FIELDS)
    edge = variant.isin(*RIGHT_EDGE_VARIANTS)
    fast = F.when(edge, parser == "percentage").otherwise(full | (variant == "native"))
    slow = ~(fast_available & ~full & (backend == SLOW_BACKEND)) & variant.isin(*SLOW_VARIANTS)
    return parser.isNotNull() & F.when(backend == FAST_BACKEND, fast).otherwise(slow)


def validated_names(names: DataFrame, name: str, known: DataFrame, known_name: str, mappings: Mapping[str, str]) -> DataFrame:
    """Names with ``valid``: whether they, or what they are mapped to, are known once
    normalised; without any known name all are (J16)."""
    have = known.select(normalize_name(F.col(known_name)).alias("_k")).distinct()
    mapped = F.coalesce(*[F.when(F.col(name) == a, F.lit(b)) for a, b in mappings.items()], F.lit(None).cast("string"))
    tried = names.select(F.col(name).alias("_n"), mapped.alias("_m")).distinct().select("_n", F.explode(F.array_compact(F.array("_n", "_m"))).alias("_t"))
    valid = tried.select("_n", normalize_name(F.col("_t")).alias("_k")).join(have, "_k", "left_semi").select("_n").distinct().withColumn("_v", F.lit(True))
    none = have.agg((F.count("*") == 0).alias("_none"))
    return names.join(valid, F.col(name) == F.col("_n"), "left").crossJoin(F.broadcast(none)).withColumn("valid", F.coalesce("_v", F.lit(False)) | F.col("_none")).drop("_n", "_v", "_none")


def empty_row_errors(rows: DataFrame, sources: DataFrame, observed: DataFrame, given: str, expected: str) -> DataFrame:
    """Faults of a hash-bound list of rows confirmed as empty (J21): code and row.

    The list is bound to its truth file's digest; each row to its screenshot's; a row may be
    given once and must stand for a row that was observed without truth."""
    keys = ["screenshot", "side", "row"]
    if given != expected:
        return rows.limit(1).select(F.lit("truth_mismatch").alias("code"), *keys)
    checked = rows.join(sources.select("screenshot", F.col("sha256").alias("_now")), "screenshot", "left")
    bad = checked.where(~F.col("side").isin("ally", "enemy") | ~F.col("row").between(0, 4)).select(F.lit("invalid_row").alias("code"), *keys)
    drift = checked.where(~F.col("source_sha256").eqNullSafe(F.col("_now"))).select(F.lit("source_mismatch").alias("code"), *keys)
    twice = rows.groupBy(*keys).count().where("count > 1").select(F.lit("duplicate_row").alias("code"), *keys)
    unused = rows.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti").select(F.lit("unused_row").alias("code"), *keys)
    return reduce(DataFrame.unionByName, (bad, drift, twice, unused))


def most_or_greatest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The older engine's gold vote: the most frequent reading if it came twice (the first met of
    equals, column ``ord``), else the greatest; and the plain greatest (A31)."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    best = by.groupBy(*keys).agg(F.max("_n").alias("_top"), F.max_by(value, F.struct("_n", -F.col("_first"))).alias("_mode"), F.max(value).alias("greatest"))
    return best.select(*keys, F.when(F.col("_top") > 1, F.col("_mode")).otherwise(F.col("greatest")).alias("gold"), "greatest")


def result_of(text: Column) -> Column:
    """Defeat or Victory as a reading of the result says."""
    up = F.upper(text)
    return F.when(up.contains("DEFEAT"), "Defeat").when(up.contains("VICT"), "Victory")


def result_vote(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The most frequent result of a key's readings, the first met of equals (column ``ord``)."""
    by = df.withColumn("_r", result_of(F.col(text))).where("_r is not null").groupBy(*keys, "_r").agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    return by.groupBy(*keys).agg(F.max_by("_r", F.struct("_n", -F.col("_first"))).alias("result"))


def linear_percentile(values: Column, share: float) -> Column:
    """Percentile of an array, linear between its sorted values."""
    ordered = F.array_sort(values)
    at = F.lit(share) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def grid_statistics(values: Column, width: int) -> Column:
    """Statistics of a grid of gray values, row by row in one array (A44): mean, std, the 1st
    and 99th percentile, dynamic range, share of clipped values, share of equal neighbours."""
    n = F.size(values)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = total(values) / n
    spread = F.sqrt(total(F.transform(values, lambda x: F.pow(x.cast("double") - mean, F.lit(2.0)))) / n)
    low, high = linear_percentile(values, 0.01), linear_percentile(values, 0.99)
    clipped = total(F.transform(values, lambda x: ((x <= 2) | (x >= 253)).cast("int"))) / n

    def equal(step: int, inside) -> Column:
        pairs = F.filter(F.transform(values, lambda x, i: F.struct(inside(i).alias("in"), (x == F.get(values, i + step)).cast("int").alias("same"))), lambda p: p["in"])
        return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(total(F.transform(pairs, lambda p: p["same"])) / F.size(pairs))

    across, down = equal(1, lambda i: (i + 1) % width != 0), equal(width, lambda i: i + width < n)
    return F.struct(mean.alias("mean"), spread.alias("std"), low.alias("p01"), high.alias("p99"), F.rint(high - low).cast("int").alias("dynamic_range"), clipped.alias("clipped"), across.alias("equal_x"), down.alias("equal_y"), ((across > 0.42) & (down > 0.42)).alias("rescaled"))


def job_health(jobs: DataFrame, worker_alive: bool = True) -> DataFrame:
    """Counters of a job service."""
    state = lambda s: F.count_if(F.col("status") == s)
    return jobs.agg(F.lit("ok" if worker_alive else "down").alias("status"), F.lit(1).alias("max_parallel_jobs"), state("queued").alias("queued_jobs"), state("processing").alias("processing_jobs"))


def fifo_statuses(jobs: DataFrame, arrival: str, seconds: str, at: Column, order: Sequence[str], lane: Sequence[str] = ()) -> DataFrame:
    """Jobs of a worker that takes them one at a time in order (T2): started, ended and the
    status at a time; a job begins when it has come and the one before has ended.

    With s(k) the work up to job k, the end of job k is the greatest of arrival(j) + s(k) - s(j - 1)
    over j <= k: one running sum and one running maximum within a worker's lane."""
    w = Window.partitionBy(*lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = jobs.withColumn("_sum", F.sum(seconds).over(w))
    ended = F.max(F.col(arrival) - F.col("_sum") + F.col(seconds)).over(w) + F.col("_sum")
    rows = summed.withColumn("ended", ended).withColumn("started", F.col("ended") - F.col(seconds))
    terminal = F.when(F.col("failed"), "failed").otherwise("completed")
    status = F.when(F.col(arrival) > at, F.lit(None)).when(F.col("started") > at, "queued").when(F.col("ended") > at, "processing").otherwise(terminal)
    return rows.withColumn("status", status).withColumn("holds_sources", status.isin("queued", "processing")).drop("_sum")


def review_state(records: DataFrame, queue: Sequence[str], index: str, decision: str, current: str) -> DataFrame:
    """The public state of each review queue (A47): its place, its length, counts by decision,
    whether it is done, and the current record's id."""
    count = lambda d: F.count_if(F.col(decision) == d).alias(d)
    here = F.col(index) == F.col(current)
    state = records.groupBy(*queue, current).agg(F.count("*").alias("total"), *[count(d) for d in ("pending", "accepted", "edited", "unknown", "skip")], F.max(F.when(here, F.col("record_id"))).alias("current_record"))
    return state.withColumn("done", F.col(current) >= F.col("total"))


def union_records(heroes: DataFrame, items: DataFrame) -> DataFrame:
    """Records of both kinds as one table."""
    return heroes.withColumn("kind", F.lit("hero")).unionByName(items.withColumn("kind", F.lit("item")))


def repeated_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids that occur more than once (U8)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or an error that names a repeated id (U8)."""
    first = repeated_ids(df, keys).first()
    if first is not None:
        raise ValueError(f"repeated id: {', '.join(str(first[k]) for k in keys)}")
    return df


def item_audit(players: DataFrame, warnings: DataFrame, queued: DataFrame) -> DataFrame:
    """Item inference by screenshot and over all (screenshot null) (A36): items inferred and
    queued, rows of seven items, screens with item warnings, counts by status as JSON."""
    row = players.groupBy("screenshot", "side", "row").agg((F.count("*") == 7).cast("long").alias("seven"))
    by_status = players.groupBy("screenshot", "status").agg(F.count("*").alias("n"))
    marked = warnings.where(reduce(lambda a, b: a | b, [F.col("text").contains(m) for m in WARNING_MARKERS])).select("screenshot").distinct().withColumn("warned", F.lit(1).cast("long"))
    base = players.groupBy("screenshot").agg(F.count("*").alias("inferred"))
    base = base.join(row.groupBy("screenshot").agg(F.sum("seven").alias("seven")), "screenshot").join(queued.groupBy("screenshot").agg(F.count("*").alias("queued")), "screenshot", "left").join(marked, "screenshot", "left").na.fill(0)
    screens = by_status.groupBy("screenshot").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("status_counts"))
    whole = by_status.groupBy("status").agg(F.sum("n").alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("status_counts"))
    total = base.agg(*[F.sum(c).alias(c) for c in ("inferred", "seven", "queued", "warned")]).crossJoin(F.broadcast(whole)).withColumn("screenshot", F.lit(None).cast("string"))
    return base.join(screens, "screenshot").unionByName(total).select("screenshot", "inferred", "queued", F.col("seven").alias("seven_item_rows"), F.col("warned").alias("screens_with_warnings"), "status_counts")


def sync_report(mappings: DataFrame, entities: DataFrame, changes: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts of a catalog's migration and synchronisation, one row."""
    m = mappings.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("mapped", "ambiguous", "failed")])
    e = entities.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_candidates") for k in ("hero", "item")])
    c = changes.agg(*[F.count_if(F.col("change") == s).alias(s) for s in ("added", "removed", "renamed", "visual_changed")])
    return m.crossJoin(e).crossJoin(c).crossJoin(failures.agg(F.count("*").alias("failed_downloads")))  # one row each


def wide_players(results: DataFrame, sides: Mapping[str, str]) -> DataFrame:
    """One row a player of wide results (P20): side, row (number less one, else its place), the
    player; rows beyond 0..4 are dropped."""
    found = None
    for side, column in sides.items():
        one = results.select("result_id", F.lit(side).alias("side"), F.posexplode(column).alias("_at", "player"))
        found = one if found is None else found.unionByName(one)
    return found.withColumn("row", F.coalesce(F.col("player.player_number") - 1, F.col("_at"))).where("row between 0 and 4").drop("_at")


def wide_items(players: DataFrame) -> DataFrame:
    """One row an item of wide players (P20): slot likewise, slots beyond 0..5 dropped; empty,
    known and other slots by occupancy and status."""
    rows = players.select("result_id", "side", "row", F.posexplode("player.items").alias("_at", "item"))
    empty, name = F.coalesce(F.col("item.is_empty"), F.lit(False)), F.col("item.item_name")
    return rows.select(
        "result_id", "side", "row", F.coalesce(F.col("item.slot") - 1, F.col("_at")).alias("slot"),
        F.when(empty, "empty").when(name.isNotNull(), "occupied").otherwise("unknown").alias("occupancy"),
        F.when(empty, "empty").when(name.isNotNull(), "ok").otherwise("unknown").alias("status"),
        F.when(name.isNotNull(), F.concat(F.lit("v1-item:"), name)).alias("class_id"),
    ).where("slot between 0 and 5")


def long_fields(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Named fields of a wide row as rows: field, value, status (P20)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").withColumn("status", F.when(F.col("value").isNull(), "unknown").otherwise("ok"))


def summary(df: DataFrame, by: Sequence[str], counted: Mapping[str, Column], averaged: Mapping[str, Column]) -> DataFrame:
    """Rows, named counts, and averages over the rows that have a value, three decimals, 0.0 of none."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counted.items()], *[F.coalesce(F.bround(F.avg(c), 3), F.lit(0.0)).alias(k) for k, c in averaged.items()])


def sorted_set(value: str) -> Column:
    """Distinct values in order."""
    return F.array_sort(F.collect_set(value))


def display(identity: Column, name: Column, status: Column) -> Column:
    """How a record is shown: empty, ``id — name``, or unknown."""
    return F.when(status == "empty", "empty").when(identity.isNull(), "UNKNOWN").otherwise(F.concat(identity.cast("string"), F.lit(" — "), name))


def stable_keys(value: Column, volatile: Sequence[str] = VOLATILE_KEYS) -> Column:
    """A map of metadata without the keys that change from run to run."""
    return F.map_filter(value, lambda k, _: ~k.isin(*volatile))


def valid_by_rules(value: Column, rules: Mapping[str, object]) -> Column:
    """Whether a value keeps a field's rules: min, max, min_length, max_length,
    allowed_values; without rules any does (P9)."""
    tests = {"min": lambda r: value >= r, "max": lambda r: value <= r, "min_length": lambda r: F.length(value.cast("string")) >= r, "max_length": lambda r: F.length(value.cast("string")) <= r, "allowed_values": lambda r: value.isin(*r)}
    return reduce(lambda a, b: a & b, [tests[k](r) for k, r in rules.items()], F.lit(True))


def hypotheses(viewports: DataFrame, profiles: DataFrame, tolerance: float) -> DataFrame:
    """Every viewport with every profile of nearly its aspect (J11); profiles are a dimension of
    fixed size: width, height, profile_id."""
    p = profiles.select("profile_id", (F.col("width") / F.col("height")).alias("_pa"))
    return viewports.withColumn("_va", F.col("width") / F.col("height")).join(F.broadcast(p), F.abs(F.col("_va") - F.col("_pa")) <= F.lit(tolerance) * F.col("_pa")).drop("_va", "_pa")


def balanced_accept(top: DataFrame, query: str, minimum: Mapping[str, float]) -> DataFrame:
    """The winner of each query with its votes over the runner-up and whether all four
    thresholds hold: prototype, rank_margin, prototype_margin, votes (X9).  A row without
    one of the scores supports nothing."""
    needed = ["prototype_similarity", *BALANCED_CHANNELS]
    w = Window.partitionBy(query).orderBy("rank")
    first = top.where("rank <= 2").withColumn("_next", F.lead(F.struct("score", *needed)).over(w)).where("rank = 1")
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & F.col(f"_next.{c}").isNotNull() for c in needed])
    votes = reduce(lambda a, b: a + b, [(F.col(c) > F.col(f"_next.{c}")).cast("int") for c in BALANCED_CHANNELS])
    lead = F.col("prototype_similarity") - F.col("_next.prototype_similarity")
    ok = complete & (F.col("prototype_similarity") >= minimum["prototype"]) & (F.col("score") - F.col("_next.score") >= minimum["rank_margin"]) & (lead >= minimum["prototype_margin"]) & (votes >= minimum["votes"])
    return first.withColumn("votes", votes).withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_next")


def asset_faults(head: Column, declared: Column, detected: Column, width: Column, height: Column, opaque: Column, spread: Column) -> Column:
    """Why a downloaded asset is refused, null if it is not (S11): bodies of markup, kinds that
    differ, sides under 16, nothing visible, one flat colour."""
    text = F.lower(F.ltrim(head))
    return (
        F.when(text.startswith("<!doctype") | text.startswith("<html") | text.startswith("<?xml") | text.startswith("<svg"), "markup_body")
        .when(detected.isNull(), "undecodable")
        .when(~declared.eqNullSafe(detected), "mime_mismatch")
        .when((width < 16) | (height < 16), "too_small")
        .when(opaque <= 0, "fully_transparent")
        .when(spread < 1, "flat_image")
    )


def redirect_faults(url: Column, hosts: Sequence[str], redirects: Column, size: Column, mime: Column, most_bytes: int = 20 << 20) -> Column:
    """Why a download is refused before its body counts (S10): scheme, host, redirects, size, kind."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:@]*)(?:[:/?#]|$)", 1))
    return F.when(~url.startswith("https://"), "not_https").when(~host.isin(*hosts), "host_not_allowed").when(redirects > 3, "too_many_redirects").when(size > most_bytes, "too_large").when(~mime.startswith("image/"), "not_an_image")
